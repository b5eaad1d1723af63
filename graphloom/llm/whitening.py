"""Whitening of embeddings by polarisation covariance.

Each entry becomes a whole number, and each distinct vector counts once.  With y = x - S / n the squares of y_i and of
y_i + y_j are summed exactly over all vectors, for every dimension and every pair of dimensions; as
(y_i + y_j)^2 = y_i^2 + 2 y_i y_j + y_j^2, half the difference of these variances is each cross-covariance.  The sums
run in whole numbers: with the whole base b nearest to S / n, d = x - b and r = S - n b, the sum of (n d - r)^2 is
n (n * sum d^2 - r^2), so the squares that a task adds up are of small centred numbers and nothing is rounded before
the covariance matrix is assembled for ``eigh``.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import written

SCALE, SHIFT = 64, 1_000_000
#: Rows that a task holds at a time, and the size below which entries' squares are summed in 64 bits.
ROWS, SMALL = 4096, 1 << 24
#: An eigenvalue of at most this share of the trace counts as none.
NOTHING = 1e-12
_TYPES = {1: np.dtype("<i1"), 2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<i8")}


def pack(x: np.ndarray) -> list[bytes]:
    """One canonical byte string per row (entries less SHIFT, in the narrowest width that holds the row): equal rows,
    and only they, have equal bytes."""
    x = x - SHIFT
    reach = np.maximum(x.max(1), -1 - x.min(1)) if x.shape[1] else np.zeros(len(x), np.int64)
    width = np.select([reach < 1 << 7, reach < 1 << 15, reach < 1 << 31], [1, 2, 4], 8)
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        raw = np.ascontiguousarray(x[at].astype(_TYPES[w])).tobytes()
        step = w * x.shape[1]
        for k, i in enumerate(at.tolist()):
            out[i] = bytes([w]) + raw[k * step : (k + 1) * step]
    return out


def unpack(codes: list[bytes], dim: int) -> np.ndarray:
    """Rows of ``pack``, as 64-bit numbers less SHIFT."""
    out = np.empty((len(codes), dim), np.int64)
    width = np.array([c[0] for c in codes])
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join(codes[i][1:] for i in at.tolist()), _TYPES[w]).reshape(len(at), dim)
    return out


def coded(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, code) of the rows whose vector has entries and neither nulls nor non-finite ones."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                lists = part.column(1)
                lengths = np.asarray(lists.value_lengths().fill_null(0), np.int64)
                flat = lists.flatten()
                missing = np.asarray(flat.is_null())
                entries = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                bad = np.concatenate([[0], np.cumsum(missing | ~np.isfinite(entries))])
                good = (lengths > 0) & (bad[bounds[1:]] == bad[bounds[:-1]])
                for dim in np.unique(lengths[good]).tolist():
                    at = np.flatnonzero(good & (lengths == dim))
                    scaled = np.floor(entries[bounds[at][:, None] + np.arange(dim)] * SCALE)
                    x = np.where(np.abs(scaled) < 2.0**62, scaled, np.sign(scaled) * 2.0**62).astype(np.int64) + SHIFT
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), pa.array(pack(x), pa.binary())], ["id", "dim", "code"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(F.col(id_col).alias("id"), vector_col).mapInArrow(code, f"id {kind}, dim int, code binary")


def _chunks(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            if part.num_rows:
                yield part, unpack(part.column(column).to_pylist(), dim)


def _whole(x: np.ndarray) -> np.ndarray:
    """64-bit numbers if squares of pair sums of a chunk fit in 64 bits, else Python's whole numbers."""
    return x if max(int(x.max()), -int(x.min())) < SMALL else x.astype(object)


def _totals(partials: DataFrame) -> dict[int, int]:
    """Exact sums by place: as many rows as places reach the driver, however many tasks there are.

    A partial sum travels as two numbers (high * 2**40 + low), so that no 64-bit sum overflows."""
    return {r[0]: (int(r[1]) << 40) + int(r[2]) for r in partials.groupBy("place").agg(F.sum("high"), F.sum("low")).collect()}


_SUMS = "place int, high decimal(38,0), low decimal(38,0)"


def _sums(places: list[int], values: list[int]) -> pa.RecordBatch:
    from decimal import Decimal

    kind = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([Decimal(v >> 40) for v in values], kind), pa.array([Decimal(v & ((1 << 40) - 1)) for v in values], kind)], ["place", "high", "low"])


def linear_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension (entries less SHIFT)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for _, x in _chunks(batches, 0, dim):
            n += len(x)
            x = x if np.abs(x).max() < 1 << 48 else x.astype(object)
            sums = [a + int(b) for a, b in zip(sums, x.sum(0))]
        if n:
            yield _sums(list(range(dim + 1)), [*sums, n])

    got = _totals(fit.select("code").mapInArrow(add, _SUMS))
    return got.get(dim, 0), [got.get(i, 0) for i in range(dim)]


def square_sums(fit: DataFrame, base: list[int]) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Exact sums of d_i^2 of every dimension and of (d_i + d_j)^2 of every pair, d = x - base."""
    dim = len(base)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_ = [0] * (dim * (dim + 1) // 2), False
        small = np.array(base, dtype=np.int64 if all(abs(b) < 1 << 62 for b in base) else object)
        for _, x in _chunks(batches, 0, dim):
            any_ = True
            d = _whole(x.astype(object) - small if np.abs(x).max() >= 1 << 61 else x - small)
            d = np.ascontiguousarray(d.T)
            at = 0
            for i in range(dim):
                pair = d[i] + d[i:]
                pair[0] = d[i]
                part = np.einsum("ij,ij->i", pair, pair) if d.dtype != object else (pair * pair).sum(1)
                for k in range(dim - i):
                    sums[at + k] += int(part[k])
                at += dim - i
        if any_:
            yield _sums(list(range(len(sums))), sums)

    got = _totals(fit.select("code").mapInArrow(add, _SUMS))
    single, double, at = [], {}, 0
    for i in range(dim):
        single.append(got.get(at, 0))
        for j in range(i + 1, dim):
            double[i, j] = got.get(at + j - i, 0)
        at += dim - i
    return single, double


@dataclass
class Whitening:
    """Fitted on ``n`` distinct vectors: exact sums (entries less SHIFT), eigenvalues and unit eigenvectors (columns)."""

    dim: int
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    covariance: np.ndarray


def covariance(n: int, sums: list[int], base: list[int], single: list[int], double: dict[tuple[int, int], int]) -> np.ndarray:
    """Polarisation: V_ij = (var(i + j) - var(i) - var(j)) / 2, in exact fractions with one rounding each."""
    rest = [s - n * b for s, b in zip(sums, base)]
    own = [n * q - r * r for q, r in zip(single, rest)]
    out = np.empty((len(sums), len(sums)))
    for i in range(len(sums)):
        out[i, i] = own[i] / (n * n)
        for j in range(i + 1, len(sums)):
            r = rest[i] + rest[j]
            out[i, j] = out[j, i] = (n * double[i, j] - r * r - own[i] - own[j]) / (2 * n * n)
    return out


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """Of coded rows (id, dim, code), fitted on the distinct vectors of the commonest length."""
    lengths = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return None
    dim = lengths[0]
    vectors = written(rows.where(F.col("dim") == dim).select("code").distinct(), "whitening-fit")
    n, sums = linear_sums(vectors, dim)
    base = [(2 * s + n) // (2 * n) for s in sums]
    v = covariance(n, sums, base, *square_sums(vectors, base))
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    sign = np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])
    return Whitening(dim, n, sums, float(np.trace(v)), values, basis * np.where(sign == 0, 1, sign), v)


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, deviation_exact) of each row and component.

    Rows go whose vector is null or empty, holds a null or non-finite entry, or is not of the commonest length (of
    equally common ones the longest).  Repeated rows stay, each with its own result, but count once in the fit.  Entries
    beyond 2**62 / 64 are taken as that.  A component without variance has a null ``whitened`` (a single vector, equal
    vectors); ``explained`` is null where nothing varies.  An empty table gives no rows.  ``deviation`` is null where it
    passes 64 bits; ``deviation_exact`` is the same as text.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    rows = written(coded(vectors, id_col, vector_col), "whitening-codes")
    model = fit(rows, components)
    if model is None:
        return rows.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (p.strip().split(" ") for p in schema.split(",")[1:])]).where("false")
    dim, n, count = model.dim, model.n, len(model.values)
    alive = model.values > max(model.trace, 0.0) * NOTHING
    scale = np.where(alive, 1 / np.sqrt(np.where(alive, model.values, 1.0)), np.nan)
    used = model.vectors[:, alive] * scale[alive]
    identity = used.T @ model.covariance @ used
    error = float(np.abs(identity - np.eye(identity.shape[0])).max()) if identity.size else 0.0
    explained = model.values / model.trace if model.trace > 0 else np.full(count, np.nan)
    # n (x - b) - r is the exact n x - S; both parts are small where the data are
    base = [(2 * s + n) // (2 * n) for s in model.sums]
    rest = [s - n * b for s, b in zip(model.sums, base)]
    rests = sum(r * r for r in rest)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        narrow = all(abs(b) < 1 << 61 for b in base)
        for part, x in _chunks(batches, 1, dim):
            d = x - np.array(base, np.int64) if narrow and np.abs(x).max() < 1 << 61 else x.astype(object) - np.array(base, object)
            reach = max(int(d.max()), -int(d.min()), 1)
            wide = d if d.dtype != object and reach * max(reach, n) * dim < 1 << 62 else d.astype(object)
            own, cross = (wide * wide).sum(1).tolist(), (wide * np.array(rest, wide.dtype)).sum(1).tolist()
            square = [n * (n * q - 2 * c) + rests for q, c in zip(own, cross)]
            centred = d.astype(np.float64) - np.array([r / n for r in rest])
            out = (centred @ model.vectors) * scale
            m = len(out)
            row, white, share = pa.array(np.repeat(np.arange(m), count)), out.ravel(), np.tile(explained, m)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(row),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                pa.array(np.full(m * count, n, np.int64)),
                pa.array([s if s < 1 << 63 else None for s in square], pa.int64()).take(row),
                pa.array(white, mask=np.isnan(white)),
                pa.array(share, mask=np.isnan(share)),
                pa.array(np.full(m * count, error)),
                pa.array([str(s) for s in square]).take(row)],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return rows.where(F.col("dim") == dim).select("id", "code").mapInArrow(project, schema)
