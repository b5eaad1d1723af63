"""SpotSigs fingerprints, in DataFrame operations alone.

A spot signature is a common word (anchor) with the content words that follow it; anchors themselves are skipped in the
chain.  The set of signatures is the fingerprint.  Sets are compared by Jaccard; the join partitions them by length, so
that only sets of near lengths meet, and prunes by prefix before it compares.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.components import written

CHAIN = 2
#: Buckets for the neighbour of each row hold about so many rows, more where there would be more than BUCKETS of them;
#: a cell that holds more than a bucket is split into so many cells a bucket.
BUCKET_ROWS, BUCKETS, FINER = 400, 1 << 16, 4

# Anchors, the commonest words of four languages.
ANCHORS = sorted({
    "the", "a", "an", "and", "or", "of", "to", "in", "is", "are", "was", "be", "that", "this", "it", "he", "she", "for",
    "on", "with", "as", "at", "by", "from", "not", "have", "has", "had", "will", "but",
    "le", "la", "les", "un", "une", "de", "des", "du", "et", "est", "que", "qui", "dans", "pour", "par", "sur", "avec", "au", "pas", "ne",
    "der", "die", "das", "den", "dem", "ein", "eine", "und", "ist", "nicht", "mit", "von", "zu", "auf", "im", "für", "sich", "auch", "es", "ich",
    "el", "los", "las", "una", "y", "en", "del", "por", "para", "con", "se", "su", "lo", "al", "como", "más", "no", "esta", "son"})


def _once(df: DataFrame, **parts: Column) -> DataFrame:
    """Adds columns that are evaluated once per row and not copied into the expressions that use them."""
    held = F.array(F.struct(*[c.alias(n) for n, c in parts.items()]))
    return df.select("*", F.inline(held))


def with_signatures(df: DataFrame, text_col: str, into: str) -> DataFrame:
    """Adds ``into``: the sorted distinct signatures (array<int>) of the whole text; empty where it has no word.

    The start of a text counts as an anchor, so that a text with a word has a signature; with fewer content words than
    a chain takes, that one signature is made of all its words.
    """
    low = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+")
    df = _once(df, _w=F.filter(low, lambda x: x != ""))
    df = _once(df, _c=F.filter("_w", lambda x: ~x.isin(ANCHORS)),
               _s=F.filter(F.transform("_w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s.x.isin(ANCHORS)))
    n = F.size("_c")
    df = _once(df, _h=F.zip_with("_c", F.slice("_c", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.hash(a, b))))
    # the k-th anchor (from 0) stands at word i, so i - k content words stand before it
    spots = F.transform("_s", lambda s, k: F.hash(s.x, F.get("_h", s.i - k)))
    whole = F.transform("_s", lambda s, k: F.get("_h", s.i - k).isNotNull())
    pairs = F.filter(F.zip_with(spots, whole, lambda a, b: F.when(b, a)), lambda x: x.isNotNull())
    start = F.when(F.size("_w") == 0, F.array().cast("array<int>")).when(n < CHAIN, F.array(F.hash(F.lit("^"), F.concat_ws(" ", "_w")))).otherwise(F.array(F.hash(F.lit("^"), F.get("_h", F.lit(0)))))
    df = _once(df, **{into: F.array_sort(F.array_distinct(F.concat(start, pairs)))})
    return df.drop("_w", "_c", "_s", "_h")


def likeness(a: str, b: str) -> Column:
    """Jaccard of two signature sets; two empty sets are alike, an empty and another are not."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def shown(signatures: str) -> Column:
    """The fingerprint as text: 8 hex digits per signature."""
    return F.array_join(F.transform(signatures, lambda x: F.substring(F.hex(x.cast("long")), -8, 8)), ",")


def _placed(rows: DataFrame, splits: list[DataFrame]) -> DataFrame:
    """The rows with ``cell``: an array, in order of descending (id, h), longer by one number for each split they are in."""
    rows = rows.withColumn("cell", F.array(F.when(F.col("id").isNull(), 1).otherwise(0)))
    for split in splits:
        whole = lambda c: F.col(c).cast("decimal(20,0)")
        part = lambda at, lo, hi: F.floor((whole(hi) - whole(at)) / (F.floor((whole(hi) - whole(lo)) / F.col("fan")) + 1)).cast("int")
        child = F.when(F.col("lo") < F.col("hi"), part("id", "lo", "hi")).otherwise(part("h", "hlo", "hhi"))
        rows = rows.join(F.broadcast(split), "cell", "left")
        rows = rows.withColumn("cell", F.when(F.col("fan").isNotNull(), F.concat("cell", F.array(child))).otherwise(F.col("cell"))).drop("lo", "hi", "hlo", "hhi", "fan")
    return rows


def cells_of(rows: DataFrame) -> tuple[list[DataFrame], DataFrame, int]:
    """(splits, cells, limit): cells of at most ``limit`` rows, unless all rows of one are equal in id and text.

    A cell that holds more is split evenly between the ids that it holds, or the hashes where it holds one id, until none
    does.  Splits and cells are tables of some FINER * BUCKETS rows at most a round, however many rows there are.
    """
    keys = written(rows.select("id", "h"), "keys")
    limit = max(BUCKET_ROWS, -(-keys.count() // BUCKETS))
    splits: list[DataFrame] = []
    while True:
        cells = written(_placed(keys, splits).groupBy("cell").agg(
            F.count("*").alias("n"), F.max(F.struct("id", "h")).alias("head"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("h").alias("hlo"), F.max("h").alias("hhi")), "cells")
        full = (F.col("n") > limit) & (F.coalesce(F.col("lo") < F.col("hi"), F.lit(False)) | (F.col("hlo") < F.col("hhi")))
        split = cells.where(full).select("cell", "lo", "hi", "hlo", "hhi", (F.ceil(F.col("n") / limit) * FINER).alias("fan"))
        if split.isEmpty():
            return splits, cells.select("cell", "n", "head"), limit
        splits.append(split)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, guest, id, text) so that, by bucket, the row after each (id descending, nulls last) is its neighbour.

    Cells of neighbouring ids are gathered into buckets; the first row of each bucket is a guest at the end of the bucket
    before it, and that of the first bucket at the end of the last.  Ids are whole numbers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64(F.col("text").isNull(), "text"))
    splits, cells, limit = cells_of(rows)
    upto = Window.orderBy("cell")
    cells = cells.withColumn("part", F.floor((F.sum("n").over(upto) - F.col("n")) / limit))
    cells = cells.withColumn("bucket", F.dense_rank().over(Window.orderBy("part")))
    cells = cells.withColumn("last", F.max("bucket").over(Window.partitionBy()))
    cells = cells.withColumn("first", F.row_number().over(Window.partitionBy("bucket").orderBy("cell")) == 1)
    cells = cells.select("cell", "bucket", "head", "first", F.when(F.col("bucket") == 1, F.col("last")).otherwise(F.col("bucket") - 1).alias("guest_at"))
    placed = _placed(rows, splits).join(F.broadcast(cells), "cell")
    is_head = F.col("first") & F.struct("id", "h").eqNullSafe(F.col("head"))
    own, guest = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest")), F.struct(F.col("guest_at").alias("bucket"), F.lit(1).alias("guest"))
    return placed.select("id", "text", "h", F.inline(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))))


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The neighbour is the next row by descending id (after the last: the first); of equal ids the texts' hashes decide,
    and repeated rows follow one another.  The edited text has its last third replaced by as many code points (or all)
    of the neighbour.  Null texts are empty; an empty text has an empty fingerprint; an empty table gives no rows; other
    columns are not read.  Ids are whole numbers; rows equal in id and text share a bucket.
    """
    dealt = with_next(docs, id_col, text_col).repartition("bucket")
    dealt = with_signatures(dealt.withColumn("text", F.coalesce("text", F.lit(""))), "text", "sig")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), F.col("h").desc())
    rows = dealt.withColumns({"next_text": F.lead("text").over(order), "next_sig": F.lead("sig").over(order)}).where("guest = 0")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    rows = _once(rows.withColumn("n_chars", n.cast("long")), edited=F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third)))
    rows = with_signatures(rows, "edited", "edited_sig")
    return rows.select(F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown("sig").alias("fingerprint"),
                       shown("edited_sig").alias("edited_fingerprint"), likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))


def near_pairs(docs: DataFrame, tau: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): each row's class of equal signature sets (id, cid), and the pairs (a, b, likeness) of classes
    at ``tau`` or more.  Rows without a word have no class.

    Sets are partitioned by length: a band spans a factor of 1 / tau, so partners stand in the same band or the next.
    Within it two sets must share one of their first few signatures, and their lengths must allow tau.
    """
    rows = with_signatures(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "sig").drop("text").where(F.size("sig") > 0)
    rows = rows.withColumns({"d0": F.xxhash64("sig"), "d1": F.xxhash64(F.lit(1), "sig"), "n": F.size("sig")})
    classes = rows.groupBy("d0", "d1", "n").agg(F.min("id").alias("cid"), F.first("sig").alias("sig"))
    members = rows.select("id", "d0", "d1", "n").join(classes.select("d0", "d1", "n", "cid"), ["d0", "d1", "n"]).select("id", "cid")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-1.0) / F.log(F.lit(tau))).cast("int")
    kept = F.col("n") - F.ceil(F.col("n") * F.lit(tau) - 1e-9) + 1
    listed = classes.withColumn("band", band).withColumn("s", F.explode(F.slice("sig", F.lit(1), kept.cast("int"))))
    x = listed.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"), "band", "s")
    y = listed.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"), F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), "s")
    near = (F.col("a") != F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(tau) - 1e-9) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    found = x.join(y, ["band", "s"]).where(near).withColumn("likeness", likeness("sa", "sb")).where(F.col("likeness") >= tau - 1e-12)
    return members, found.select("a", "b", "likeness").distinct()
