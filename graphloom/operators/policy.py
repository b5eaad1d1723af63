"""A5, A6, H1-H7: file fetch, guarded writes and the write policy, over tables.

Proposed writes are a DataFrame ``writes(seq, file_path, content)``; the policy
classifies every row (the first failing check decides), and accepted writes are
applied to a ``files(path, content)`` table: the last write per path wins
(``max_by`` on ``seq``) and replaces or adds that path.  Nothing touches a disk.

Checks, in order (a NULL path, or one with a NUL character, is invalid before all):
1. target = lexical ``resolve`` of the path (absolute, ``.`` / ``..`` collapsed;
   symlinks need a disk and are not followed);
2. roots: split on ``:`` or ``;``, trimmed, blanks dropped, each resolved; no roots
   means everything is allowed; the test is a raw string prefix (``strict`` adds
   a ``/`` so that ``/repo`` does not admit ``/repo-evil``);
3. blocked types: lower-cased suffix in the blocked list, or the name ``.env``;
4. any path segment equal to ``.git``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import lexicon as L
from graphloom.functions import text as TX


def parse_roots(raw: str | None) -> list[str]:
    """Roots configuration string -> list (split on ':' or ';', trimmed, blanks dropped)."""
    if not raw:
        return []
    return [r.strip() for r in raw.replace(";", ":").split(":") if r.strip()]


def resolve(path: Column, cwd: str = "/") -> Column:
    """H1: absolute, lexically normalised path."""
    absolute = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(cwd.rstrip("/") + "/"), path))
    return TX.normalize_path(absolute)


def classify_writes(writes: DataFrame, roots: list[str] | None = None, cwd: str = "/", strict: bool = False) -> DataFrame:
    """H1-H7: (seq, file_path, target, status, reason, bytes_written, warning) per proposed write."""
    name = TX.file_name(F.col("target"))
    suffix = F.lower(TX.file_suffix(name))
    # the path is folded once per row: an inlined struct isn't copied into the expressions that read it
    df = writes.select("*", F.inline(F.array(F.struct(resolve(F.col("file_path"), cwd).alias("target")))))
    root_cols = [TX.normalize_path(F.lit(r if r.startswith("/") else cwd.rstrip("/") + "/" + r)) for r in (roots or [])]
    if root_cols:
        if strict:
            inside = F.lit(False)
            for r in root_cols:
                inside = inside | (F.col("target") == r) | F.col("target").startswith(F.concat(r, F.lit("/")))
        else:
            inside = F.lit(False)
            for r in root_cols:
                inside = inside | F.col("target").startswith(r)
    else:
        inside = F.lit(True)
    blocked = suffix.isin(L.BLOCKED_SUFFIXES) | (name == L.BLOCKED_NAME)
    in_vcs = F.array_contains(F.split(F.col("target"), "/"), L.VCS_DIR)
    invalid = F.col("file_path").isNull() | F.contains(F.col("file_path"), F.lit("\0"))
    reason = (
        F.when(invalid, F.lit(L.MSG_INVALID_PATH))
        .when(~inside, F.concat(F.lit(L.MSG_OUTSIDE[0]), F.col("target"), F.lit(L.MSG_OUTSIDE[1])))
        .when(blocked, F.concat(F.lit(L.MSG_BLOCKED[0]), name, F.lit(L.MSG_BLOCKED[1])))
        .when(in_vcs, F.lit(L.MSG_VCS))
    )
    status = F.when(reason.isNull(), F.lit("success")).otherwise(F.lit("error"))
    ok = reason.isNull()
    return df.select(
        "seq",
        "file_path",
        "target",
        status.alias("status"),
        reason.alias("reason"),
        F.when(ok, F.octet_length("content").cast("bigint")).alias("bytes_written"),
        F.when(ok & (suffix == L.STALE_SUFFIX), F.concat(F.lit("Graph is stale for "), name, F.lit(L.MSG_STALE))).alias(
            "warning"
        ),
        "content",
    )


def result_json(classified: DataFrame) -> Column:
    """H7: the tool's result record as JSON text (properly escaped)."""
    success = F.to_json(
        F.struct(F.col("status"), F.col("target").alias("path"), F.col("bytes_written"), F.col("warning"))
    )
    error = F.to_json(F.struct(F.col("status"), F.col("reason")))
    return F.when(F.col("status") == "success", success).otherwise(error)


def apply_writes(files: DataFrame, classified: DataFrame) -> DataFrame:
    """A6: files after accepted writes; last write per path wins; adds or replaces, never deletes."""
    accepted = classified.filter(F.col("status") == "success").groupBy(F.col("target").alias("path")).agg(
        F.max_by("content", "seq").alias("content")
    )
    kept = files.join(accepted.select("path"), "path", "left_anti")
    return kept.select("path", "content").unionByName(accepted.select("path", "content"))


def read_files(files: DataFrame, requests: DataFrame) -> DataFrame:
    """A5: (request_id, file_path, status, content); a missing path yields the error text.

    No root check and no path normalisation, as for the tool being replaced.
    """
    f = files.select(F.col("path").alias("_p"), F.col("content").alias("_c"))
    j = requests.join(f, F.col("file_path") == F.col("_p"), "left")
    found = F.col("_p").isNotNull()
    return j.select(
        "request_id",
        "file_path",
        F.when(found, F.lit("ok")).otherwise(F.lit("not_found")).alias("status"),
        F.when(found, F.col("_c")).otherwise(F.concat(F.lit(L.MSG_FILE_NOT_FOUND), F.col("file_path"))).alias("content"),
    )
