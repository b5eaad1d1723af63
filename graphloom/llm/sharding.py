"""Sharding by histogram sort.

Rows are ordered by (hash of the text, id).  Candidate splitters (probes) are laid over the key range; one pass counts
the exact bytes below every probe across all partitions; probes are refined inside the brackets that hold a target
until each splitter is settled; then the rows are exchanged once.  Equal texts are neighbours, so a shard border cuts
through a group of copies only where no border between texts is near enough to its target.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.components import written

#: Probes inside a bracket and pass; a range holds about so many rows or bytes.
PROBES, RANGE_ROWS, RANGE_BYTES = 64, 2_000_000, 4 << 30
#: A border between texts is taken if it is off by at most this share of a shard.
TOLERANCE = 0.01
LOWEST = -(1 << 63)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow rows: id, size (UTF-8 bytes plus 1; null: 1), crc, h (60 bits of the text's md5; null: -1), k (id)."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.coalesce(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(-1)).alias("h"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("k"),
    )


@dataclass
class Bracket:
    """Where a target lies: ``below`` bytes stand under key ``low``; the target is within [low, high]."""

    target: float
    low: int
    high: int
    below: float


def histogram(rows: DataFrame, key: str, weight: str, probes: np.ndarray) -> list[tuple[int, float, int, int, int]]:
    """(bucket, weight, rows, least key, largest key) of the rows between neighbouring probes; bucket i holds the keys
    with probes[i-1] <= key < probes[i].  One pass; each task sends at most a row per bucket that it meets."""
    shared = rows.sparkSession.sparkContext.broadcast(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, sums = shared.value, {}
        for batch in batches:
            keys, weights = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sort = np.argsort(keys, kind="stable")
            keys, weights = keys[sort], weights[sort]
            bucket = np.searchsorted(cuts, keys, "right")
            heads = np.flatnonzero(np.diff(bucket, prepend=-1))
            tails = np.append(heads[1:], len(bucket))
            for b, w, n, lo, hi in zip(bucket[heads].tolist(), np.add.reduceat(weights, heads).tolist() if len(heads) else [], (tails - heads).tolist(), keys[heads].tolist(), keys[tails - 1].tolist()):
                old = sums.get(b)
                sums[b] = (w, n, lo, hi) if old is None else (old[0] + w, old[1] + n, min(old[2], lo), max(old[3], hi))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *[pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(4)]], ["b", "w", "n", "lo", "hi"])

    got = rows.select(key, weight).mapInArrow(count, "b int, w long, n long, lo long, hi long")
    return [tuple(r) for r in got.groupBy("b").agg(F.sum("w"), F.sum("n"), F.min("lo"), F.max("hi")).orderBy("b").collect()]


def borders(rows: DataFrame, key: str, weight: str, targets: list[float], offset: float, slack: float, exact: bool) -> list[tuple[int, float, int, float]]:
    """Around each target: (key a, weight below a, key b, weight below b) of the nearest borders at or under and over
    it, b being the key that follows a, or a border within ``slack`` of the target twice.

    Brackets shrink to keys that occur, so a bracket of one key ends the search.  ``offset`` is the weight below all.
    """
    probes_each = max(8, PROBES * 8 // max(1, len(targets)))
    out: dict[int, tuple[int, float, int, float]] = {}
    least, most = rows.agg(F.min(key), F.max(key)).first()
    open_ = {i: Bracket(t, least, most, offset) for i, t in enumerate(targets)}
    first = True
    while open_:
        brackets = sorted({(b.low, b.high) for b in open_.values()})
        each = PROBES * 64 if first else probes_each
        cuts = np.unique(np.array([p for lo, hi in brackets for p in {lo, *(lo + (hi - lo + 1) * j // each for j in range(1, each)), min(hi + 1, (1 << 63) - 1)}], dtype=np.int64))
        inside = rows
        if not first:
            keep = F.lit(False)
            for lo, hi in brackets if len(brackets) <= 64 else [(brackets[0][0], brackets[-1][1])]:
                keep = keep | F.col(key).between(lo, hi)
            inside = rows.where(keep)
        found = histogram(inside, key, weight, cuts)
        first = False
        for i, b in list(open_.items()):
            own = [r for r in found if r[3] >= b.low and r[4] <= b.high]
            below = b.below
            if not own:
                out[i] = (b.low, below, b.low, below)
                del open_[i]
                continue
            for number, (_, w, n, lo, hi) in enumerate(own):
                if below + w > b.target or number == len(own) - 1:
                    if not exact and abs(b.target - below) <= slack:
                        out[i] = (lo, below, lo, below)
                        del open_[i]
                    elif lo == hi or not exact and abs(below + w - b.target) <= slack:
                        out[i] = (lo, below, hi + 1, below + w) if lo == hi else (hi + 1, below + w, hi + 1, below + w)
                        del open_[i]
                    else:
                        open_[i] = Bracket(b.target, lo, hi, below)
                    break
                below += w
    return [out[i] for i in range(len(targets))]


def splitters(rows: DataFrame, weight: str, targets: list[float], slack: float, exact: bool = True) -> list[tuple[int, int]]:
    """Keys (h, k) at which to cut, one per target: rows below it weigh as near the target as can be.

    The nearest border between texts if it is within ``slack``; else the nearest between rows of the text there.
    With ``exact`` off any border within ``slack`` will do.
    """
    out: list[tuple[int, int] | None] = []
    split: dict[int, tuple[float, list[int]]] = {}
    for i, (t, (a, under, b, over)) in enumerate(zip(targets, borders(rows, "h", weight, targets, 0.0, slack, exact))):
        key, off = (a, t - under) if t - under <= over - t else (b, over - t)
        if off <= slack or a == b:
            out.append((key, LOWEST))
        else:
            out.append(None)
            split.setdefault(a, (under, []))[1].append(i)
    for h, (under, which) in split.items():
        own = rows.where(F.col("h") == h)
        for i, (a, below, b, above) in zip(which, borders(own, "k", weight, [targets[i] for i in which], under, slack, exact)):
            cut = a if targets[i] - below <= above - targets[i] else b
            out[i] = (h, min(cut, (1 << 63) - 1))
    return out


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """Narrow rows of all documents: id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    Shards hold nearly equal bytes.  Null texts count one byte and stand first, null ids first among equal texts;
    repeated rows share a border only by their order.  An empty table gives no rows.  Ranges within a shard are cut by
    weight (bytes and rows alike), so that the one exchange spreads hot texts too.
    """
    rows = written(keyed(docs, id_col, text_col), "shard-keys")
    n, size = rows.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).where("false")
    outer = splitters(rows, "size", [size * j / n_shards for j in range(1, n_shards)], tolerance * size / n_shards)
    mean = max(1, size // n)
    rows = rows.withColumn("load", F.col("size") + F.lit(mean))
    count = max(64, n // RANGE_ROWS, size // RANGE_BYTES)
    load = size + n * mean
    inner = splitters(rows, "load", [load * j / count for j in range(1, count)], 0.25 * load / count, exact=False)
    cuts = sorted({*outer, *inner})
    shared = docs.sparkSession.sparkContext.broadcast((np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)))
    border = [cuts.index(c) + 1 for c in outer]

    @F.pandas_udf("int")
    def range_of(h, k):
        ch, ck = shared.value
        low = np.searchsorted(ch, h.to_numpy(), "left")
        high = np.searchsorted(ch, h.to_numpy(), "right")
        out = high.copy()
        own = np.flatnonzero(high > low)
        kk = k.to_numpy()
        for i in own:
            out[i] = low[i] + np.searchsorted(ck[low[i] : high[i]], kk[i], "right")
        return h.__class__(out.astype(np.int32))

    placed = rows.withColumn("r", range_of("h", "k"))
    sizes = {r[0]: r[1] for r in placed.groupBy("r").count().collect()}
    shard_of, before, at = [], [], 0
    for r in range(len(cuts) + 1):
        own = sum(1 for b in border if b <= r)
        at = at if shard_of and shard_of[-1] == own else 0
        shard_of.append(own)
        before.append(at)
        at += sizes.get(r, 0)
    ranges = docs.sparkSession.createDataFrame(list(zip(range(len(before)), shard_of, before)), "r int, shard int, start long")
    order = Window.partitionBy("r").orderBy("h", "k", "crc", "size")
    ranked = placed.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    return ranked.join(F.broadcast(ranges), "r").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("rank")).alias("slot"))
