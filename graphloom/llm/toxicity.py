"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of labelled rows, split in three by hash, gives in turn: the lexicon (whole words and word beginnings
that mark toxic rows, besides a short fixed list), the trees, and the calibration.  Every text is then scored whole.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrow import mask
from graphloom.llm.stores import release
from graphloom.session import scratch_path

#: Labelled rows that may be learned from, about so many of either label, by hash of the id.
MAX_TOXIC, MAX_CLEAN = 3000, 7000
LEXICON, LEAST_ROWS, LEAST_WEIGHT = 4000, 3, 2.0

# Insults, and words that address the reader.
INSULTS = {"idiot", "idiots", "moron", "stupid", "dumb", "loser", "scum", "trash", "pathetic", "worthless", "disgusting",
           "clown", "fool", "imbecile", "bastard", "jerk", "creep", "vermin", "garbage", "hate"}
ADDRESS = {"you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie",
           "tu", "te", "toi", "ton", "ta", "vous", "votre", "vos", "ti", "tus", "usted", "ustedes", "vosotros"}
DISGUISE = str.maketrans("0134578@$!", "oieastbasi")

WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"(?<![^\W_])[^\W_]*[^\W\d_](?:[0-9@$!*]+[^\W\d_])+[^\W_]*|(?<!\w)(?:[^\W\d_][.\-_*]){3,}[^\W\d_](?!\w)")
#: Bytes that are capitals, parts of letters, or signs that can stand in a masked word (in runs, or one between letters).
UPPER = bytes(range(65, 91))
LETTER = mask(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
SIGN, JOINT = mask(lambda b: 48 <= b <= 57 or b in b"@$!*"), mask(lambda b: b in b".-_*")
RUN = re.compile(r"([^\W\d_])\1{2,}")
SHOUT = re.compile(r"[!?]{2,}")
NAMES = ["hits", "hit_rate", "kinds", "near_you", "you_rate", "capitals", "shouted", "marks", "mark_runs", "masked",
         "masked_hits", "runs", "weight_sum", "weight_max", "weight_mean", "size"]


def keys_of(word: str) -> list[str]:
    """A word, and its beginnings of 3 to 8 letters where more letters follow."""
    return [word, *[word[:k] + "~" for k in range(3, min(9, len(word)))]]


class Lexicon(dict):
    """Weight of each word: its own or that of its heaviest beginning, 0 for all others.  Filled as words are met."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        if word in INSULTS:
            own = max(3.0, self.weights.get(word, 0.0))
        else:
            own = max([self.weights.get(k, 0.0) for k in keys_of(word)])
        self[word] = own
        return own

    def __reduce__(self):
        return Lexicon, (self.weights,)


def may_mask(signs: np.ndarray) -> bool:
    """False only where MASKED finds nothing in the text of these bytes."""
    letter = LETTER[signs]
    return bool((letter[:-1] & SIGN[signs[1:]]).any() or (letter[:-2] & JOINT[signs[1:-1]] & letter[2:]).any())


def may_run(low: str) -> bool:
    """False only where RUN finds nothing in the lowered text."""
    c = np.frombuffer(low.encode(), np.uint8) if low.isascii() else np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    return bool((LETTER[np.minimum(c[2:], 128)] & (c[2:] == c[1:-1]) & (c[1:-1] == c[:-2])).any())


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of one whole text, in the order of NAMES; all 0 for null and empty texts."""
    text = text or ""
    low = text.lower()
    found = WORD.findall(low)
    n = max(len(found), 1)
    weight = [lexicon[w] for w in found]
    hits = [i for i, x in enumerate(weight) if x > 0]
    you = ADDRESS.intersection(found)
    near = sum(1 for i in hits if not you.isdisjoint(found[max(0, i - 5) : i + 6])) if hits and you else 0
    addressed = sum(map(found.count, you)) if you else 0
    letters = max(sum(map(len, found)), 1)
    raw = text.encode("utf-8", "replace")
    capitals = len(raw) - len(raw.translate(None, UPPER))
    signs = np.frombuffer(raw, np.uint8)
    marks = text.count("!") + text.count("?")
    masked = MASKED.findall(text) if may_mask(signs) else []
    clear = [re.sub(r"[^\w]|_", "", m.lower().translate(DISGUISE)) for m in masked]
    masked_hits = sum(1 for w in clear if lexicon[w] > 0)
    runs = RUN.findall(low) if may_run(low) else []
    if runs:
        masked_hits += sum(1 for w in found if RUN.search(w) and lexicon[RUN.sub(r"\1", w)] > 0)
    total = sum(weight)
    return [np.log1p(len(hits)), len(hits) / n, np.log1p(len({found[i] for i in hits})), near / n, addressed / n,
            capitals / letters, float(capitals > 0.6 * letters), marks / n, len(SHOUT.findall(text)) / n if marks else 0.0,
            len(masked) / n, np.log1p(masked_hits), len(runs) / n, np.log1p(total), max(weight, default=0.0), total / n, np.log1p(n)]


class Trees:
    """Boosted regression trees for the logistic loss, over features cut at quantiles."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, cuts: int = 32, least: int = 8):
        self.rounds, self.depth, self.rate, self.cuts, self.least = rounds, depth, rate, cuts, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        rate = (y.sum() + 1) / (len(y) + 2)
        self.start = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.start)
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.cuts + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            gradient, curve = y - p, p * (1 - p)
            feature = np.zeros(2**self.depth - 1, np.int64)
            cut = np.full(2**self.depth - 1, np.inf)
            node = np.zeros(len(y), np.int64)
            for at in range(2**self.depth - 1):
                rows = np.flatnonzero(node == at)
                best = 1e-6
                if len(rows) >= 2 * self.least:
                    g, h = gradient[rows], curve[rows]
                    for f, e in enumerate(edges):
                        if not len(e):
                            continue
                        b, size = binned[rows, f], len(e) + 1
                        gs, hs = np.cumsum(np.bincount(b, g, size)), np.cumsum(np.bincount(b, h, size))
                        ns = np.cumsum(np.bincount(b, minlength=size))
                        gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                        gain[(ns < self.least) | (ns[-1] - ns < self.least)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, feature[at], cut[at] = gain[k], f, e[k] if k < len(e) else np.inf
                node[rows] = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            leaf = node - (2**self.depth - 1)
            size = 2**self.depth
            value = self.rate * np.bincount(leaf, gradient, size) / (np.bincount(leaf, curve, size) + 1)
            self.trees.append((feature, cut, value))
            margin += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        every = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[every, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots and values of the nondecreasing least-squares fit of y by margin."""
    sort = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v in zip(margin[sort], y[sort]):
        blocks.append([float(v), 1.0, float(m), float(m)])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = high
    knots, values = [], []
    for s, n, low, high in blocks:
        value = (s + 0.05) / (n + 0.1) if n < 5 else s / n
        knots += [low, high] if high > low else [low]
        values += [value] * (2 if high > low else 1)
    return np.array(knots), np.maximum.accumulate(np.array(values))


class Model:
    """Lexicon, trees and calibration; ``score`` is strictly higher where the trees' margin is."""

    def __init__(self, lexicon: Lexicon, trees: Trees, knots: np.ndarray, values: np.ndarray):
        self.lexicon, self.trees, self.knots, self.values = lexicon, trees, knots, values

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        margin = self.trees.margin(np.array([features(t, self.lexicon) for t in texts]))
        plain = 1 / (1 + np.exp(-margin))
        fitted = np.interp(margin, self.knots, self.values) if len(self.knots) else plain
        return np.clip(0.98 * fitted + 0.02 * plain, 0, 1)


def _part(id_col: str, shift: int):
    return F.pmod(F.xxhash64(F.lit(shift), F.col(id_col)), F.lit(1 << 20))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """About MAX_TOXIC and MAX_CLEAN labelled rows with their texts (one per id), written to the shared folder.

    Only the chosen ids, whose number these bounds limit, are sent to the scan of the documents.
    """
    labels = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    share = [int(min(1.0, most / max(sizes.get(y, 0), 1)) * (1 << 20)) for y, most in ((0, MAX_CLEAN), (1, MAX_TOXIC))]
    chosen = labels.where(_part(id_col, 1) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    path = scratch_path(docs.sparkSession, "toxicity-sample")
    got = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen.withColumnRenamed(id_col, "_id")), F.col(id_col) == F.col("_id")).drop("_id")
    got.select(F.col(id_col).alias("id"), "text", "toxic", _part(id_col, 2).alias("part")).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _keys(batches: Iterator[pa.RecordBatch], wanted: set | None) -> Iterator[pa.RecordBatch]:
    release()
    counts: Counter = Counter()
    for batch in batches:
        for value in batch.column(0):
            words = {*WORD.findall((value.as_py() or "").lower())}
            keys = {k for w in words for k in keys_of(w)}
            counts.update(keys if wanted is None else keys & wanted)
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["key", "n"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled rows given (leave held-out rows out before)."""
    rows = sample(docs, labels, id_col, text_col, label_col)
    half = 1 << 19
    part = {r[0]: r[1] for r in rows.where(F.col("part") < half).groupBy("toxic").count().collect()}

    def tally(toxic: int, wanted: set | None) -> DataFrame:
        own = rows.where((F.col("part") < half) & (F.col("toxic") == toxic)).select("text")
        return own.mapInArrow(lambda b: _keys(b, wanted), "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))

    marked = {r[0]: r[1] for r in tally(1, None).where(F.col("n") >= LEAST_ROWS).collect()}
    clean = {r[0]: r[1] for r in tally(0, {*marked}).collect()} if marked else {}
    n1, n0 = part.get(1, 0), part.get(0, 0)
    weights = {k: float(np.log((n + 0.5) / (n1 + 1)) - np.log((clean.get(k, 0) + 0.5) / (n0 + 1))) for k, n in marked.items()}
    kept = sorted(((-marked[k] * w, k) for k, w in weights.items() if w >= LEAST_WEIGHT))[:LEXICON]
    lexicon = Lexicon({k: weights[k] for _, k in kept})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            x = [features(v.as_py(), lexicon) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2), batch.column(3)], ["x", "toxic", "part", "id"])

    got = rows.where(F.col("part") >= half).select("text", "toxic", "part", F.xxhash64("id").alias("id")).mapInArrow(measure, "x array<double>, toxic int, part long, id long").toPandas().sort_values("id", kind="stable")
    if not len(got):
        return Model(lexicon, Trees(), np.zeros(0), np.zeros(0))
    x, y = np.stack(got["x"].to_numpy()), got["toxic"].to_numpy(float)
    fitting = got["part"].to_numpy() < half + (half * 6 // 10)
    trees = Trees().fit(x[fitting], y[fitting]) if fitting.any() else Trees()
    knots, values = isotonic(trees.margin(x[~fitting]), y[~fitting]) if (~fitting).sum() >= 30 else (np.zeros(0), np.zeros(0))
    return Model(lexicon, trees, knots, values)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (calibrated probability of toxicity), predicted (1 if score >= 0.5).

    Null and empty texts get the score of a text without any sign.  Without labelled rows every score is the prior.
    Repeated rows and ids give a row each; a null id stays null; other columns are not read.
    """
    kind, shared = docs.schema[id_col].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = shared.value
        for batch in batches:
            score = np.concatenate([np.zeros(0), *[own.score(batch.column(1).slice(i, 256).to_pylist()) for i in range(0, batch.num_rows, 256)]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows whose score is under 0.5, with all their columns."""
    at, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield part.filter(pa.array(own.score(part.column(at).to_pylist()) < 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
