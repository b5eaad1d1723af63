"""B1: lex every file into a token table with nesting depths.

One regex pass per file (two group extractions of the same lexer) gives the file's
tokens as an array.  What depends on the tokens before (brace / paren depth, character
offsets, top-level regions, class-member segments, matching parentheses) is counted over
that array by running sums in one Arrow call per batch of files, as arrays of the same
length; ``posexplode`` then makes one row per significant token, and a neighbour of a token is
looked up in the array.

Scale notes:
* the files are hash-partitioned once on a 96-bit file key ``(fid, fh)`` into partitions of
  about ``TARGET_SOURCE_BYTES`` of text; token rows are neither sorted nor shuffled before they
  are aggregated per class member.
* the token rows carry the 12-byte key, not the path, and never the content.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import lexicon as L
from graphloom.session import ship

FILE_KEY = ["fid", "fh"]


# a partition of the token job holds about this much source text; its token arrays are some 20 times as much
TARGET_SOURCE_BYTES = 4 * 1024 * 1024

#: Tokens that nesting goes by; a token's code is its place here, -1 for any other.
MARKS = ["{", "}", "(", ")", ";", ".", "@", "=", "class", "interface", "enum", "record", "new"]
#: Per token: offset, depths, region, member segment, positions of the owning annotation, the region's keyword and the
#: paren that matches (null where there is none), and bits: declaration keyword, annotation name, its dot, previous token
#: is an annotation name, previous token follows ``new``, first or last token of a member.
NESTING = ["off", "bd", "pd", "region", "seg", "ann_owner", "kw_pos", "close_pos", "bits"]


def file_partitions(files: DataFrame) -> int:
    """Partitions for the token job by the text's exact length (one narrow pass), and
    ``spark.sql.shuffle.partitions`` at least."""
    size = files.agg(F.sum(F.length("content"))).first()[0] or 0
    base = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(base, -(-size // TARGET_SOURCE_BYTES))


def key_files(files: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """files(path, content[, error]) -> (fid, fh, path, content, error), hash-partitioned by the file key.

    The partition count is explicit (by the text's length, see ``file_partitions``): the
    shuffle carries compact file text that later explodes ~10x into token rows, so AQE
    must not coalesce it by its pre-explode size.  The key covers the content, so that two
    versions of one path stay apart.
    """
    keyed = files.select(
        F.xxhash64("path", "content").alias("fid"),
        F.hash("path", "content").alias("fh"),
        "path",
        "content",
        (F.col("error") if "error" in files.columns else F.lit(None).cast("string")).alias("error"),
    )
    n = num_partitions or file_partitions(files)
    return keyed.repartition(n, *FILE_KEY)


def nesting(tok: pa.Array, ws_len: pa.Array, ident: pa.Array) -> pa.Array:
    """The ``NESTING`` arrays of each file from its tokens, the blanks before them and whether they are names."""
    sizes = tok.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first = np.repeat(ends - sizes, sizes)  # of each token the place of its file's first one
    n = len(first)
    at = np.arange(n)
    words = tok.flatten()
    blanks = ws_len.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    name = ident.flatten().to_numpy(zero_copy_only=False).astype(bool)
    code = pc.index_in(words, value_set=pa.array(MARKS)).fill_null(-1).to_numpy(zero_copy_only=False)
    mark = {m: code == i for i, m in enumerate(MARKS)}

    def before(x: np.ndarray) -> np.ndarray:
        """Sum over the earlier tokens of the file."""
        total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        return total[:-1] - total[first]

    def previous(x: np.ndarray, none) -> np.ndarray:
        return np.where(at > first, np.concatenate([x[:1], x[:-1]]), none)

    def last(x: np.ndarray) -> np.ndarray:
        """Place of the file's last token up to here for which x holds, or -1."""
        seen = np.maximum.accumulate(np.where(x, at, -1)) if n else at
        return np.where(seen >= first, seen, -1)

    def where_found(x: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (place >= 0) & x[place] if n else x

    before_name, before_dot = previous(name, False), previous(mark["."], False)
    next_name = np.concatenate([name[1:], [False]])[:n] & (at + 1 < np.repeat(ends, sizes))
    off = before(blanks + pc.utf8_length(words).to_numpy(zero_copy_only=False)) + blanks
    bd = before(mark["{"].astype(np.int64) - mark["}"])
    pd = before(mark["("].astype(np.int64) - mark[")"])
    top, member = (bd == 0) & (pd == 0), (bd == 1) & (pd == 0)
    region = before((mark[";"] & top) | (mark["}"] & member))
    # a top-level declaration keyword (``record`` only when a name follows)
    is_kw = top & ~before_dot & (mark["class"] | mark["interface"] | mark["enum"] | (mark["record"] & next_name))
    # member-level = / ; (and the class body's opening brace) decide whether a
    # } closes an initialiser (= …{…};) or a member
    marker = ((mark["="] | mark[";"]) & member) | (mark["{"] & top)
    initialiser = where_found(mark["="], previous(last(marker), -1))
    seg = before((mark[";"] & member) | (mark["}"] & (bd == 2) & (pd == 0) & ~initialiser))
    # the member-level annotation that owns a token inside annotation arguments
    owner = previous(last(mark["@"] & member), -1)
    # a chain of names and dots is what the token before its first one makes it
    chain = last(~((name & before_dot) | (mark["."] & before_name)))
    after_at = where_found(previous(mark["@"], False), chain)
    after_new = where_found(previous(mark["new"], False), chain)
    ann = name & after_at
    kw = last(is_kw)
    kw = np.where((kw >= 0) & (region[kw] == region), kw, -1) if n else kw
    # within one paren level, ( and ) alternate, so the ) that closes a ( is the next paren of the same level
    paren = np.flatnonzero(mark["("] | mark[")"])
    level = pd[paren] - mark[")"][paren]
    order = np.lexsort((paren, level, first[paren]))
    paren, level = paren[order], level[order]
    pairs = (first[paren[1:]] == first[paren[:-1]]) & (level[1:] == level[:-1]) & mark["("][paren[:-1]]
    close = np.full(n, -1)
    close[paren[:-1][pairs]] = paren[1:][pairs]
    # the members of a class: the tokens in its body, by region and segment
    body = where_found(mark["class"], kw) & (bd >= 1) & ~(mark["}"] & (bd == 1))
    starts = body & ~(previous(body, False) & (previous(region, -1) == region) & (previous(seg, -1) == seg))
    closed = body & np.concatenate([(starts | ~body | (at == first))[1:], [True]])[:n]
    bits = (is_kw + 2 * ann + 4 * (mark["."] & after_at) + 8 * previous(ann, False) + 16 * previous(name & after_new, False)
            + 32 * (starts | closed))

    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())

    def lists(x: np.ndarray, place: bool = False) -> pa.Array:
        values = pa.array(x - first if place else x, pa.int32(), mask=x < 0) if place else pa.array(x, pa.int32())
        return pa.ListArray.from_arrays(offsets, values)

    places = {"ann_owner": owner, "kw_pos": kw, "close_pos": close}
    plain = {"off": off, "bd": bd, "pd": pd, "region": region, "seg": seg, "bits": bits}
    return pa.StructArray.from_arrays([lists(places[c], True) if c in places else lists(plain[c]) for c in NESTING], NESTING)


def token_table(keyed_files: DataFrame) -> DataFrame:
    """Significant tokens with depths, offsets, region and member-segment ids.

    Columns: fid, fh, pos, tok, ws_len, off (0-based char offset of tok), bd / pd
    (brace / paren depth before the token), p1..p5 / n1..n2 (neighbour tokens),
    region (top-level declaration id), seg (class-member id), rkw / rname (the
    declaration keyword and class name of the token's region), ann (identifier
    belongs to an annotation name), newchain (identifier follows ``new``),
    p1_ann (previous token is an annotation name), edge (first or last token of a
    member), close_next (for ``(``: the token after its matching ``)``).

    Rows of one file key are one stream of tokens, each as often as there are rows.
    """
    ship(keyed_files.sparkSession)
    count = F.arrow_udf(nesting, "struct<" + ", ".join(f"{c}: array<int>" for c in NESTING) + ">")
    content = F.coalesce("content", F.lit(""))
    lexed = keyed_files.groupBy(*FILE_KEY).agg(F.first("content").alias("content"), F.count(F.lit(1)).cast("int").alias("copies")).select(
        *FILE_KEY,
        "copies",
        F.regexp_extract_all(content, F.lit(L.JAVA_LEXER), 1).alias("ws"),
        # only the end of the text makes an empty token
        F.array_remove(F.regexp_extract_all(content, F.lit(L.JAVA_LEXER), 2), "").alias("toks"),
    ).select(
        *FILE_KEY,
        "copies",
        "toks",
        F.transform(F.slice("ws", F.lit(1), F.size("toks")), F.length).alias("ws"),
        F.transform("toks", lambda t: t.rlike(r"^[\p{L}_$]")).alias("ident"),
    )

    def repeated(name: str) -> Column:
        return F.when(F.col("copies") == 1, F.col(name)).otherwise(F.flatten(F.transform(name, lambda x: F.array_repeat(x, F.col("copies"))))).alias(name)

    lexed = lexed.select(*FILE_KEY, "copies", repeated("toks"), repeated("ws"), repeated("ident"))
    counted = lexed.select(*FILE_KEY, "copies", "toks", "ws", count("toks", "ws", "ident").alias("c"))
    rows = counted.select(*FILE_KEY, "copies", "toks", "ws", *[F.col(f"c.{c}").alias(f"_{c}") for c in NESTING], F.posexplode_outer("toks").alias("place", "tok"))

    def neighbour(step: int) -> Column:
        return F.get("toks", F.col("place") + step)

    def own(name: str) -> Column:
        return F.get(f"_{name}", F.col("place"))

    def original(place: Column) -> Column:
        """The position in the text of a place in the stream."""
        return F.floor(place / F.col("copies")).cast("int")

    def bit(value: int) -> Column:
        return own("bits").bitwiseAND(F.lit(value)) > 0

    return rows.where(F.col("tok").isNotNull()).select(
        *FILE_KEY, original(F.col("place")).alias("pos"), "tok", F.get("ws", F.col("place")).alias("ws_len"),
        *[own(c).cast("bigint").alias(c) for c in ("off", "bd", "pd")],
        *[neighbour(-i).alias(f"p{i}") for i in range(1, 6)],
        *[neighbour(i).alias(f"n{i}") for i in (1, 2)],
        own("region").cast("bigint").alias("region"), original(own("ann_owner")).alias("ann_owner"), bit(1).alias("is_kw"), own("seg").cast("bigint").alias("seg"),
        bit(2).alias("ann"), bit(4).alias("ann_dot"), bit(8).alias("p1_ann"), bit(16).alias("p1_new"), bit(32).alias("edge"),
        F.get("toks", own("kw_pos")).alias("rkw"), F.get("toks", own("kw_pos") + 1).alias("rname"), F.get("toks", own("close_pos") + 1).alias("close_next"),
    )


def token_digest(tokens: DataFrame, keyed_files: DataFrame) -> DataFrame:
    """Per-file digest of the token table: counts of ( and { tokens, max depth."""
    agg = tokens.groupBy(*FILE_KEY).agg(
        F.count_if(F.col("tok") == "(").cast("bigint").alias("n_lparen"),
        F.count_if(F.col("tok") == "{").cast("bigint").alias("n_lbrace"),
        F.max(F.when(F.col("tok") == "{", F.col("bd") + 1)).cast("bigint").alias("max_depth"),
        F.count(F.lit(1)).cast("bigint").alias("n_tokens"),
    )
    return keyed_files.select(*FILE_KEY, "path").join(agg, FILE_KEY, "left").select(
        "path",
        F.coalesce("n_lparen", F.lit(0)).cast("bigint").alias("n_lparen"),
        F.coalesce("n_lbrace", F.lit(0)).cast("bigint").alias("n_lbrace"),
        F.coalesce("max_depth", F.lit(0)).cast("bigint").alias("max_depth"),
    )
