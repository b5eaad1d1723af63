"""A1: folders of source files, listed and read by Spark tasks, whatever the names.

``list_tree`` expands a tree level by level: the folders of a level are rows, a job lists them, and the folders that it
finds are the next level's rows.  Each level is written to the shared scratch folder, so a lost executor repeats one
level.  Nothing is filtered but by the name pattern: hidden and underscore names and empty files count.  ``read_tree``
reads the files of a listing; a file that can't be read is a row with an error, never a failed job.  ``write_files`` is
the sink: one file per row.

Paths are local ones (of a file system that all machines share) or URIs that ``pyarrow.fs`` opens (s3, gs, hdfs ...).
"""
from __future__ import annotations

import fnmatch
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import scratch_path, ship

#: Bytes that a reading task handles, and that it holds before it hands rows on.
TASK_BYTES, HELD_BYTES = 64 << 20, 8 << 20
#: A content beyond this does not fit in one value.
MAX_BYTES = (1 << 31) - 1
_ENTRY = "path string, name string, kind string, length long, error string"
_CONTENT = "path string, name string, length long, content binary, error string"


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _reason(exc: BaseException) -> str:
    return getattr(exc, "strerror", None) or str(exc) or type(exc).__name__


def local_path(path: str) -> str | None:
    """The plain path of a local path or ``file:`` URI; None for any other URI."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def _entries(folder: str) -> Iterator[tuple[str, str, str, int]]:
    """(path, name, kind, length) of a folder's entries; kind is ``file`` or ``folder``.  A link to a folder is not
    followed, a link to a file counts as that file."""
    plain = local_path(folder)
    if plain is not None:
        with os.scandir(plain) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield f"{plain.rstrip('/')}/{e.name}", e.name, "folder", 0
                elif not e.is_dir():
                    try:
                        length = e.stat().st_size
                    except OSError:  # a link that leads nowhere: reading it will say so
                        length = 0
                    yield f"{plain.rstrip('/')}/{e.name}", e.name, "file", length
        return
    fs, inner = pafs.FileSystem.from_uri(folder)
    for info in fs.get_file_info(pafs.FileSelector(inner, recursive=False)):
        kind = "folder" if info.type == pafs.FileType.Directory else "file"
        yield f"{folder.rstrip('/')}/{info.base_name}", info.base_name, kind, info.size or 0


def _utf8(text: str) -> bool:
    try:
        text.encode()
        return True
    except UnicodeEncodeError:
        return False


def _exists(root: str) -> bool:
    plain = local_path(root)
    if plain is not None:
        return os.path.isdir(plain)
    fs, inner = pafs.FileSystem.from_uri(root)
    return fs.get_file_info(inner).type == pafs.FileType.Directory


def list_tree(spark: SparkSession, root: str, pattern: str = "*.java", folders: str = "skip") -> DataFrame:
    """(path, name, length, error) of every file under ``root`` whose name matches ``pattern`` (case counts).

    A folder whose name matches is no file: it is walked like any other (``folders='error'`` gives it as a failed row
    besides).  A folder that can't be listed is a row with an error, as is a name that is not UTF-8.  A missing root
    raises FileNotFoundError.
    """
    if not _exists(root):
        raise FileNotFoundError(f"no such folder: {root}")
    ship(spark)
    base = scratch_path(spark, "tree")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                try:
                    for path, name, kind, length in _entries(folder):
                        match = fnmatch.fnmatchcase(name, pattern)
                        if not _utf8(path):
                            if match or kind == "folder":
                                out.append((path.encode("utf-8", "replace").decode(), name.encode("utf-8", "replace").decode(), "failed", length, "the name is not UTF-8"))
                        elif kind == "folder":
                            out.append((path, name, kind, 0, None))
                            if match and folders == "error":
                                out.append((path, name, "failed", 0, "Is a directory"))
                        elif match:
                            out.append((path, name, kind, length, None))
                        if len(out) >= 10_000:
                            yield _arrow(out, _ENTRY)
                            out = []
                except Exception as exc:
                    out.append((folder, folder.rstrip("/").rsplit("/", 1)[-1], "failed", 0, _reason(exc)))
        if out:
            yield _arrow(out, _ENTRY)

    level = 0
    frontier, count = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string"), 1
    while count:
        # round-robin: neighbours of one parent are dealt to different tasks
        dealt = frontier.repartition(max(1, min(count, max(tasks, count // 64))))
        dealt.mapInArrow(expand, _ENTRY).write.parquet(f"{base}/level={level}")
        found = spark.read.schema(_ENTRY).parquet(f"{base}/level={level}")
        frontier = found.where("kind = 'folder'").select("path")
        count, level = frontier.count(), level + 1
    return spark.read.schema(_ENTRY + ", level int").parquet(base).where("kind <> 'folder'").select("path", "name", "length", "error")


def _read(path: str) -> bytes:
    plain = local_path(path)
    if plain is not None:
        with open(plain, "rb") as f:
            return f.read(MAX_BYTES + 1)
    fs, inner = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(inner) as f:
        return f.read(MAX_BYTES + 1)


def read_tree(listing: DataFrame) -> DataFrame:
    """(path, name, length, content, error) of the rows of a listing (path, and length and error if it has them).

    Every row comes back.  A file that is gone, unreadable, a folder or beyond 2 GB has a null content and a reason; a
    row that came with an error keeps it and is not read.  A null path is an error too.  ``length`` is that of the bytes
    read (null on an error).
    """
    spark = listing.sparkSession
    ship(spark)
    size = F.col("length") if "length" in listing.columns else F.lit(None).cast("long")
    error = F.col("error") if "error" in listing.columns else F.lit(None).cast("string")
    rows = listing.select("path", size.alias("length"), error.alias("error"))
    files, total = rows.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(files, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for path, error in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name, content = None if path is None else path.rstrip("/").rsplit("/", 1)[-1], None
                if error is None and path is None:
                    error = "no path"
                if error is None:
                    try:
                        content = _read(path)
                        if len(content) > MAX_BYTES:
                            content, error = None, "larger than 2 GB"
                    except Exception as exc:
                        error = _reason(exc)
                size = None if content is None else len(content)
                if out and held + (size or 0) > HELD_BYTES or len(out) >= 10_000:
                    yield _arrow(out, _CONTENT)
                    out, held = [], 0
                out.append((path, name, size, content, error))
                held += size or 0
        if out:
            yield _arrow(out, _CONTENT)

    return rows.select("path", "error").repartition(tasks).mapInArrow(read, _CONTENT)


def _write(path: str, content: bytes) -> None:
    plain = local_path(path)
    if plain is None:
        fs, inner = pafs.FileSystem.from_uri(path)
        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(inner) as f:
            f.write(content)
        return
    folder = os.path.dirname(plain)
    os.makedirs(folder, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=folder, prefix=".part-")
    with os.fdopen(handle, "wb") as f:
        f.write(content)
    os.replace(part, plain)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write each row of files(path, content: text or bytes) to ``root`` + path; (path, bytes, error) per row.

    Runs at once; the result is a table in the shared scratch folder.  A file appears whole or not at all, and a task
    that runs again writes the same file again.  Paths are taken as distinct; null paths and null contents are errors.
    """
    spark = files.sparkSession
    ship(spark)
    top = root.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                error = "no path" if path is None else "no content" if content is None else None
                if error is None:
                    try:
                        _write(f"{top}/{path.lstrip('/')}", content)
                    except Exception as exc:
                        error = _reason(exc)
                out.append((path, None if error else len(content), error))
            yield _arrow(out, "path string, bytes long, error string")

    done = scratch_path(spark, "files-written")
    files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(write, "path string, bytes long, error string").write.parquet(done)
    return spark.read.parquet(done)
