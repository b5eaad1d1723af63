"""Exact n-gram Jaccard join that skips by set relations.

Sets of word shingles are ordered rarest first, and each set is listed under its first few shingles only.  A list is
searched with position and size at hand: where the rest behind the two positions can't reach the overlap that the sizes
ask for, the entry is skipped.  Answers are derived rather than searched again where sets are related: equal sets are
one set; each list first asks only one set of each size class (its pivot: the one with the fewest rarer shingles, as the
original of a group of copies has); lists whose sets already hang together are skipped; and a pair measured against a
common pivot is decided by its differences to it where these suffice.  Of the pairs left, those whose listed shingles
alone differ by more than the threshold allows are dropped; only the rest is compared element by element.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from graphloom.llm.arrow import NOT_SPACE, mix, short_batches, slices, text_buffer, words
from graphloom.llm.components import components, written
from graphloom.llm.stores import release

#: Cells of the count sketch that orders shingles by frequency; a fixed size, and only the order depends on it.
SKETCH_BITS = 18
SLICE_BYTES = 1 << 19
#: Pairs of sets that a worker holds at a time: a row of a pair carries two whole sets.
PAIR_ROWS = 256
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the n+1 bounds of the rows among them.

    A row of fewer words has its whole sequence as one shingle; a row without words has none.
    """
    n = len(offsets) - 1
    _, _, row, codes = words(data, offsets, NOT_SPACE)
    if not len(row):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    m = len(codes) - size + 1
    parts, owner = [], []
    if m > 0:
        together = row[:m] == row[size - 1 :]
        value = np.full(m, size, np.uint64)
        for k in range(size):
            value += codes[k : m + k] * _FACTORS[k % 5] * np.uint64(2 * (k // 5) + 1)
        parts.append(mix(value[together]))
        owner.append(row[:m][together])
    for i in np.flatnonzero((count > 0) & (count < size)):
        own, c = codes[first[i] : first[i] + count[i]], int(count[i])
        parts.append(mix(np.array([c + sum(int(own[k]) * int(_FACTORS[k % 5]) * (2 * (k // 5) + 1) for k in range(c)) & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        owner.append(np.array([i]))
    value, owner = np.concatenate(parts), np.concatenate(owner)
    sort = np.argsort(owner, kind="stable")
    value, owner = value[sort], owner[sort]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    sets = [np.unique(value[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def digests(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums that identify each set."""
    out = []
    for salt in (np.uint64(0x51ED270B27D4EB4F), np.uint64(0xD6E8FEB86659FD93)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ salt), dtype=np.uint64)])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.int64))
    return out[0], out[1]


def _each(batches: Iterator[pa.RecordBatch], size: int):
    release()
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for i, j in slices(offsets, SLICE_BYTES):
            values, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
            yield batch.column(0).slice(i, j - i), values, bounds, *digests(values, bounds)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.astype(np.int64)))


def describe(docs: DataFrame, size: int, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray]:
    """Narrow rows (id, n, d0, d1) of all rows, written; and the frequency class of each sketch cell."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["id", "n", "d0", "d1", "cell"]
        for ids, values, bounds, d0, d1 in _each(batches, size):
            cells += np.bincount((values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(cells))
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(d0, mask=n == 0), pa.array(d1, mask=n == 0), pa.nulls(len(ids), pa.int32())], names)
        at = np.flatnonzero(cells)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), ids.type), pa.array(cells[part]), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int64()), pa.array(part, pa.int32())], names)

    both = written(docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(scan, f"id {kind}, n long, d0 long, d1 long, cell int"), "sets")
    sums = both.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(1 << SKETCH_BITS, np.float64)
    cells[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return both.where("cell is null").drop("cell"), np.minimum(255, 8 * np.log2(cells + 1)).astype(np.uint8)


def classes_of(docs: DataFrame, size: int, num: int, den: int, frequency: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct set, written: cid, d0, d1, n, least (smallest id), prefix (rarest shingles first)."""
    kind, shared = docs.schema[id_col].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(frequency)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for ids, values, bounds, d0, d1 in _each(batches, size):
            n = np.diff(bounds)
            keep = n - -(-num * n // den) + 1
            out = [np.zeros(0, np.uint64)]
            for a, b, k in zip(bounds[:-1], bounds[1:], keep):
                own = values[a:b]
                out.append(own[np.argsort(rarity[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[:k]])
            prefix = _lists(np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out[1:]])]))
            batch = pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(d0), pa.array(d1), prefix], ["id", "n", "d0", "d1", "prefix"])
            yield batch.filter(pa.array(n > 0))

    rows = docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(scan, f"id {kind}, n long, d0 long, d1 long, prefix array<long>")
    one = rows.groupBy("d0", "d1", "n").agg(F.min("id").alias("least"), F.first("prefix").alias("prefix"))
    return written(one.withColumn("cid", F.monotonically_increasing_id()), "classes")


def _reaches(num: int, den: int):
    """Position and size filter of entries x and y of one list (both positions from 0)."""
    return ((F.col("x.n") * den >= F.col("y.n") * num) & (F.col("y.n") * den >= F.col("x.n") * num)
            & (F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) * (num + den) >= (F.col("x.n") + F.col("y.n")) * num))


def _pairs(joined: DataFrame) -> DataFrame:
    """Each pair once, the smaller cid first."""
    return joined.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def sieve(pairs: DataFrame, classes: DataFrame, frequency: np.ndarray, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose listed shingles leave the threshold within reach.

    Up to the end of the list that ends first in the common order, a shingle that only one of the two lists holds is
    not in the other set at all; these shingles must not outnumber the difference that the sizes allow.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(frequency)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rarity = shared.value
        for batch in batches:
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            (xv, xb), (yv, yb) = (_flat(batch.column(i)) for i in (4, 5))
            xr, yr = (rarity[(v >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] for v in (xv, yv))
            near = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y, u, v = xv[xb[i] : xb[i + 1]], yv[yb[i] : yb[i + 1]], xr[xb[i] : xb[i + 1]], yr[yb[i] : yb[i + 1]]
                r, h = min((int(u[-1]), int(x[-1])), (int(v[-1]), int(y[-1])))
                x, y = x[(u < r) | ((u == r) & (x <= h))], y[(v < r) | ((v == r) & (y <= h))]
                apart = len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True))
                near[i] = apart * (num + den) <= (na[i] + nb[i]) * (den - num)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near))

    own = classes.select("cid", "n", "prefix")
    half = pairs.select("a", "b").join(own.toDF("b", "nb", "pb"), "b")
    full = half.join(own.toDF("a", "na", "pa"), "a")
    return full.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(keep, "a long, b long")


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the bounds of its rows among them."""
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(lists.offsets) - lists.offsets[0].as_py()


def sets_of(docs: DataFrame, size: int, wanted: DataFrame, text_col: str) -> DataFrame:
    """(cid, elements) of the wanted classes (cid, d0, d1), written.  The scan is sent a bit map of their digests
    (2 MB at most, so all sets pass it beyond some millions; the join after it is exact)."""
    bits = 24
    marks = np.zeros(1 << bits, bool)
    marks[wanted.select(F.shiftrightunsigned("d0", 64 - bits).cast("int").alias("c")).distinct().toArrow()["c"].to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for _, values, bounds, d0, d1 in _each(batches, size):
            cell = (d0.astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            keep = ((packed[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool) & (np.diff(bounds) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(d0), pa.array(d1), _lists(values, bounds)], ["d0", "d1", "elements"]).filter(pa.array(keep))

    rows = docs.select(F.lit(None).cast("int").alias("id"), text_col).mapInArrow(scan, "d0 long, d1 long, elements array<long>")
    return written(rows.join(wanted, ["d0", "d1"]).groupBy("cid").agg(F.first("elements").alias("elements")), "elements")


def measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, same) of each pair: sizes and overlap, element by element."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            (xv, xb), (yv, yb) = _flat(batch.column(2)), _flat(batch.column(3))
            same = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                one, other = xv[xb[i] : xb[i + 1]], yv[yb[i] : yb[i + 1]]
                at = np.searchsorted(one, other)
                at[at == len(one)] = 0
                same[i] = int((one[at] == other).sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(xb), pa.int64()), pa.array(np.diff(yb), pa.int64()), pa.array(same)], ["a", "b", "na", "nb", "same"])

    half = pairs.join(sets.withColumnRenamed("cid", "b").withColumnRenamed("elements", "eb"), "b")
    full = half.join(sets.withColumnRenamed("cid", "a").withColumnRenamed("elements", "ea"), "a")
    return full.select("a", "b", "ea", "eb").mapInArrow(count, "a long, b long, na long, nb long, same long")


def join(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The join as three frames: rows (id, n, d0, d1), classes (cid, d0, d1, n, least, component) and links (a, b)
    between classes of different sets.

    Words are runs without white space, with A-Z lowered; two rows link when overlap * den >= union * num.  Null,
    empty and blank texts have an empty set, no class and no links.  Rows of equal sets are one class; repeated rows
    and ids fall together; null ids are allowed and never chosen as the least while another is there.
    """
    rows, frequency = describe(docs, size, id_col, text_col)
    classes = classes_of(docs, size, num, den, frequency, id_col, text_col)
    listed = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "h"))
    often = listed.groupBy("h").agg(F.count("*").alias("of")).where("of > 1").select("h")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(2 * den / (num + den))))
    lists = written(listed.join(often, "h").withColumn("band", band), "lists")
    pivots = lists.groupBy("h", "band").agg(F.min(F.struct("pos", "cid", "n")).alias("p")).select("h", "band", "p.*")
    first = _pairs(lists.alias("x").join(pivots.alias("y"), ["h", "band"]).where(_reaches(num, den) & (F.col("x.cid") != F.col("y.cid"))))
    tried = written(first, "first")
    spark = docs.sparkSession
    with short_batches(spark, PAIR_ROWS):
        first = written(sieve(tried, classes, frequency, num, den), "asked")

    meets = F.col("same") * den >= (F.col("na") + F.col("nb") - F.col("same")) * num
    ids = classes.select("cid", "d0", "d1")

    def needed(pairs: DataFrame) -> DataFrame:
        cids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        return ids.join(cids, "cid", "left_semi")

    sets = sets_of(docs, size, needed(first), text_col)
    with short_batches(spark, PAIR_ROWS):
        known = written(measure(first, sets), "known")
    links = known.where(meets).select("a", "b")
    parts = components(links)

    inside = lists.join(parts.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    mixed = inside.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("h")
    rest = written(inside.join(mixed, "h"), "rest")
    second = _pairs(rest.alias("x").join(rest.alias("y"), "h").where((F.col("x.cid") < F.col("y.cid")) & (F.col("x.component") != F.col("y.component")) & _reaches(num, den)))
    second = second.join(tried, ["a", "b"], "left_anti")

    # Differences to a pivot: of two sets that share one, the difference lies between those of their differences' sizes.
    each = known.select("a", "b", "na", "nb", (F.col("na") + F.col("nb") - 2 * F.col("same")).alias("off"))
    each = each.select(F.col("a").alias("p"), F.col("b").alias("c"), F.col("nb").alias("nc"), "off").union(each.select(F.col("b").alias("p"), F.col("a").alias("c"), F.col("na").alias("nc"), "off"))
    near = each.groupBy("c").agg(F.min(F.struct("off", "p", "nc")).alias("w")).select("c", "w.*")
    told = (second.join(near.select(F.col("c").alias("a"), F.col("off").alias("oa"), F.col("p").alias("pa"), F.col("nc").alias("na")), "a", "left")
            .join(near.select(F.col("c").alias("b"), F.col("off").alias("ob"), F.col("p").alias("pb"), F.col("nc").alias("nb")), "b", "left"))
    most = (F.col("na") + F.col("nb")) * (den - num)  # a difference d links when d * (den + num) is at most this
    told = told.withColumn("answer", F.when(F.col("pa") == F.col("pb"), F.when((F.col("oa") + F.col("ob")) * (den + num) <= most, F.lit(1)).when(F.abs(F.col("oa") - F.col("ob")) * (den + num) > most, F.lit(0))))
    told = written(told.select("a", "b", "answer"), "second")
    with short_batches(spark, PAIR_ROWS):
        open_ = written(sieve(told.where("answer is null").select("a", "b"), classes, frequency, num, den), "open")
    sets = sets_of(docs, size, needed(open_), text_col)
    with short_batches(spark, PAIR_ROWS):
        late = measure(open_, sets).where(meets).select("a", "b")
        links = written(links.union(told.where("answer = 1").select("a", "b")).union(late), "links")
    parts = components(links)
    joined = classes.drop("prefix").join(parts.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    return rows, written(joined, "joined"), links


def component_ids(classes: DataFrame) -> DataFrame:
    """(d0, d1, component_id): the smallest id of each class's component."""
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    return classes.select("d0", "d1", "component").join(least, "component").drop("component")


def near_duplicates(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links; its own id for an empty set)."""
    rows, classes, _ = join(docs, size, num, den, id_col, text_col)
    got = rows.join(component_ids(classes), ["d0", "d1"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return got.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component (the smallest id), with all columns; rows with an empty set all stay.

    Of repeated rows with that id and set any one stays; where all ids of a component are null, one of them stays.
    """
    rows, classes, _ = join(docs, size, num, den, id_col, text_col)
    taken = {c.lower() for c in docs.columns}
    tail = "_"
    while any(f"{c}{tail}" in taken for c in ("_n", "_d0", "_d1", "_id", "_k0", "_k1")):
        tail += "_"
    n, d0, d1, least, k0, k1 = (f"{c}{tail}" for c in ("_n", "_d0", "_d1", "_id", "_k0", "_k1"))
    first = classes.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "d0", "d1")).alias("k")).select(F.col("k.least").alias(least), F.col("k.d0").alias(k0), F.col("k.d1").alias(k1))
    same_set = (F.col(d0) == F.col(k0)) & (F.col(d1) == F.col(k1))
    kept = _tagged(docs, size, text_col, (n, d0, d1)).join(first, F.col(f"`{id_col}`").eqNullSafe(F.col(least)) & same_set, "left").where((F.col(n) == 0) | F.col(k0).isNotNull())
    again = rows.where("n > 0").groupBy("id", "d0", "d1").agg(F.count("*").alias("of")).where("of > 1")
    again = written(first.join(again, F.col("id").eqNullSafe(F.col(least)) & (F.col("d0") == F.col(k0)) & (F.col("d1") == F.col(k1)), "left_semi").select(k0, k1), "again")
    own = [F.col(f"`{c}`") for c in docs.columns]
    if again.isEmpty():
        return kept.select(*own)
    kept = kept.drop(least, k0, k1)
    once = kept.join(again, same_set, "left_anti").select(*own)
    return once.union(kept.join(again, same_set, "left_semi").dropDuplicates([d0, d1]).select(*own))


def _tagged(docs: DataFrame, size: int, text_col: str, names: tuple[str, str, str]) -> DataFrame:
    """The rows with the size and digests of their sets, as ``names``."""
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, *[StructField(c, LongType()) for c in names]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            for i, j in slices(offsets, SLICE_BYTES):
                values, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                d0, d1 = digests(values, bounds)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(bounds)), pa.array(d0), pa.array(d1)], [*part.schema.names, *names])

    return docs.mapInArrow(scan, schema)


#: Three-word shingles, 0.9 or more; the components by a recursive walk along the links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 2], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
