"""Language of a text by multilingual mixture inference.

Each language has a distribution over letter 4-grams (hashed to a fixed number of cells), learned from labelled rows.
A document is a mixture of languages: expectation-maximisation estimates its proportions, and the set of languages is
the nested one (by proportion) with the best likelihood less a penalty for each further language.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrow import slices, text_buffer
from graphloom.llm.stores import release

CELLS = 1 << 16
#: Labelled rows per language that the distributions are learned from, by hash of the id (about so many).
TRAIN_ROWS = 4000
STEPS, SLICE_BYTES = 6, 1 << 20
#: Overlapping 4-grams repeat each letter four times; their log likelihood counts a quarter.
REPEAT = 4.0
UNKNOWN = "und"


def _fold() -> np.ndarray:
    """A-Z to a-z, letters and bytes beyond ASCII kept, all else a blank."""
    t = np.full(256, 32, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


FOLD = _fold()


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, count) of the 4-grams of each row, which is taken with a blank before and after it."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    padded = np.full(len(data) + 2 * n + 3, 32, np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64), sizes)
    padded[np.arange(len(data)) + 2 * row + 1] = FOLD[data]
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes + 2)
    m = len(owner)
    code = padded[:m] | padded[1 : m + 1] << np.uint32(8) | padded[2 : m + 2] << np.uint32(16) | padded[3 : m + 3] << np.uint32(24)
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    left = np.repeat(starts + sizes + 2, sizes + 2) - np.arange(m)
    keep = (left >= 4) & (code != 0x20202020)
    cell = (code[keep] * np.uint32(0x9E3779B1)) >> np.uint32(16)
    key, count = np.unique(owner[keep] << 16 | cell.astype(np.int64), return_counts=True)
    return key >> 16, key & 0xFFFF, count


def _batches(batch: pa.RecordBatch, at: int):
    data, offsets = text_buffer(batch.column(at))
    for i, j in slices(offsets, SLICE_BYTES):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


class Model:
    """Log probabilities of the cells in each language, add-one smoothed."""

    def __init__(self, rows: pa.Table | None):
        """``rows``: lang, cell, n, each pair of lang and cell once; None where nothing was learned."""
        names = np.array(rows["lang"].to_pylist() if rows is not None else [], object)
        self.names = sorted(set(names))
        counts = np.zeros((CELLS, len(self.names)), np.float64)
        for i, name in enumerate(self.names):
            own = names == name
            counts[rows["cell"].to_numpy()[own], i] = rows["n"].to_numpy()[own]
        self.p = ((counts + 1) / (counts.sum(0) + CELLS)).astype(np.float32)

    def mixtures(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row: proportions of the languages (0 beyond the set chosen), and log likelihood per 4-gram."""
        n, k = len(offsets) - 1, len(self.names)
        out, like = np.zeros((n, k), np.float32), np.full(n, -np.inf)
        if not k:
            return out, like
        row, cell, count = grams(data, offsets)
        p, weight = self.p[cell], count.astype(np.float32)
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        if not len(heads):
            return out, like
        docs, own = row[heads], np.cumsum(np.diff(row, prepend=row[0]) != 0)
        total = np.add.reduceat(weight, heads)

        def fit(share, at, w, where, of, size):
            for _ in range(STEPS):
                r = at * share[of]
                r *= (w / r.sum(1))[:, None]
                share = np.add.reduceat(r, where) / size[:, None]
            return share, np.add.reduceat(w * np.log((at * share[of]).sum(1)), where)

        alone = np.add.reduceat(np.log(p) * weight[:, None], heads)
        best = alone.argmax(1)
        share = np.eye(k, dtype=np.float32)[best]
        value = alone.max(1) / REPEAT
        if k > 1:
            full, _ = fit(np.full((len(docs), k), 1 / k, np.float32), p, weight, heads, own, total)
            rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
            open_ = np.arange(len(docs))
            for size in range(2, k + 1):
                part = np.isin(own, open_)
                renumber = np.cumsum(np.bincount(open_, minlength=len(docs))) - 1
                of = renumber[own[part]]
                where = np.flatnonzero(np.diff(of, prepend=-1))
                begin = np.where(rank[open_] < size, np.maximum(full[open_], 1e-3), 0).astype(np.float32)
                begin /= begin.sum(1, keepdims=True)
                got, log = fit(begin, p[part], weight[part], where, of, total[open_])
                scored = log / REPEAT - (size - 1) * np.log(total[open_] + 1)
                better = scored > value[open_]
                share[open_[better]], value[open_[better]] = got[better], scored[better]
                open_ = open_[better]
                if not open_.size:
                    break
        out[docs], like[docs] = share, value / np.maximum(total, 1)
        return out, like


def learn(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    """Cell counts of about ``train_rows`` rows of each language, those whose id hashes lowest; summed by Spark."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return Model(None)
    limit = F.coalesce(*[F.when(F.col(lang_col) == name, F.lit(int(min(1.0, train_rows / n) * (1 << 20)))) for name, n in sizes.items()])
    kept = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < limit).select(F.col(lang_col).cast("string"), text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, j, data, offsets in _batches(batch, 1):
                row, cell, n = grams(data, offsets)
                for name in set(names[i:j]):
                    own = np.array([x == name for x in names[i:j]])[row]
                    sums[name] = sums.get(name, 0) + np.bincount(cell[own], n[own], minlength=CELLS)
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at].astype(np.int64))], ["lang", "cell", "n"])

    got = kept.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    return Model(got.toArrow())


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter: an ASCII one, or else any that Unicode calls so."""
    ascii_ = np.concatenate([[0], np.cumsum((FOLD[data] != 32) & (data < 128))])
    found = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.flatnonzero(~found):
        text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
        found[i] = any(c.isalpha() for c in text)
    return found


def infer(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, its proportion, log likelihood per 4-gram) of each row."""
    share, like = model.mixtures(data, offsets)
    if not model.names:
        return [UNKNOWN] * len(share), np.zeros(len(share)), like
    letters, best = has_letter(data, offsets), share.argmax(1)
    top = share[np.arange(len(share)), best].astype(np.float64)
    names = [model.names[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
    return names, np.clip(np.where(letters, top, 0.0), 0, 1), like


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (proportion of that language).

    Null, empty and letterless texts are ``und`` with score 0, as is every text if nothing was learned.  Of equal
    proportions the first name in order wins.  Repeated rows and ids give a row each; a null id stays null; other
    columns are not read.  Texts are taken whole.
    """
    kind, shared = docs.schema[id_col].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = shared.value
        for batch in batches:
            for i, j, data, offsets in _batches(batch, 1):
                names, score, _ = infer(own, data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Rows whose text has a language that makes up at least ``least`` of it, with all their columns."""
    at, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = shared.value
        for batch in batches:
            for i, j, data, offsets in _batches(batch, at):
                names, score, _ = infer(own, data, offsets)
                keep = (np.array(names) != UNKNOWN) & (score >= least)
                yield batch.slice(i, j - i).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
