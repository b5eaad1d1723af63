"""Benchmark decontamination with suffix arrays of the training text.

Each task builds a suffix array over the words of a slice of documents (a shard), and every suffix of the test items
is binary-searched in every shard.  Sorting goes as deep as a window (13 words by default): the suffixes that begin
with a test window stand together, and neighbouring finds on one diagonal are one longer match.  Words are compared by
64-bit hashes first, and every match is then compared word by word.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrow import ALNUM, lower_table, slices, text_buffer, words
from graphloom.llm.stores import release

#: Bytes of document text in one shard, and of test text in one block that a task holds at a time.
SHARD_BYTES, BLOCK_BYTES = 6 << 20, 16 << 20


def order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the codes by their first ``depth`` codes, and each suffix's rank among those.

    Ranks of 1, 2, 4 ... codes are doubled; the last step overlaps so that exactly ``depth`` codes are compared.
    """
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    size, n = 1, len(codes)
    while size < depth:
        step = min(size, depth - size)
        later = np.zeros(n, np.int64)
        if step < n:
            later[:-step] = rank[step:]
        rank = np.unique(rank * (int(rank.max()) + 1) + later, return_inverse=True)[1].astype(np.int64) + 1
        size += step
    return np.argsort(rank, kind="stable"), rank


def search(codes: np.ndarray, suffixes: np.ndarray, wanted: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range [low, high) of the sorted suffixes that begin with each wanted row (its first ``lengths`` codes)."""
    n, depth = len(codes), wanted.shape[1]
    padded = np.concatenate([codes, np.zeros(depth, codes.dtype)])
    bounds = []
    for after in (False, True):
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), n, np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            at, undecided = suffixes[middle], np.arange(len(open_))
            right = np.full(len(open_), after)
            for k in range(depth):
                undecided = undecided[lengths[open_[undecided]] > k]
                if not undecided.size:
                    break
                here, asked = padded[at[undecided] + k], wanted[open_[undecided], k]
                right[undecided[here < asked]] = True
                right[undecided[here > asked]] = False
                undecided = undecided[here == asked]
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        bounds.append(low)
    return bounds[0], bounds[1]


class Block:
    """Some test items: words, and every suffix that is long enough to be a window."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        data, offsets = text_buffer(pa.array(texts, pa.string()))
        start, end, row, codes = words(data, offsets, ALNUM)
        self.ids, self.low = ids, lower_table()[data].tobytes()
        self.start, self.end, self.codes = start, end, codes | np.uint64(1)
        first = np.searchsorted(row, np.arange(len(ids)), "left")
        count = np.searchsorted(row, np.arange(len(ids)), "right") - first
        self.suffix = np.concatenate([np.zeros(0, np.int64), *[np.arange(f, f + max(1, c - window + 1)) for f, c in zip(first, count) if c]])
        self.item = row[self.suffix] if len(row) else np.zeros(0, np.int64)
        self.first, self.length = first, np.minimum(window, count)[self.item]
        self.last = (first + count)[self.item]
        padded = np.concatenate([self.codes, np.zeros(window, np.uint64)])
        self.wanted = padded[self.suffix[:, None] + np.arange(window)]


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """The test items as broadcast blocks of at most ``block_bytes`` of text each (or one longer item).

    The driver reads them partition by partition and holds one block; a task also holds one at a time.
    """
    sc, held, size, out = benchmark.sparkSession.sparkContext, [], 0, []

    def close():
        if held:
            out.append(sc.broadcast(Block([r[0] for r in held], [r[1] for r in held], window)))
            held.clear()

    for r in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).toLocalIterator():
        more = len((r[1] or "").encode())
        if size + more > block_bytes:
            close()
            size = 0
        held.append((r[0], r[1]))
        size += more
    close()
    return out


class Shard:
    """Words of some documents, with a separator after each, and their suffix array."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.start, self.end, self.row, codes = words(data, offsets, ALNUM)
        self.data, n = data, len(offsets) - 1
        self.count = np.bincount(self.row, minlength=n)
        self.first = np.cumsum(self.count) - self.count
        #: Document word i stands at i + its row among the codes; code 0 ends each document.
        self.codes = np.zeros(len(codes) + n, np.uint64)
        self.codes[np.arange(len(codes)) + self.row] = codes | np.uint64(1)
        self.owner = np.repeat(np.arange(n), self.count + 1)
        self.suffixes = order(self.codes, window)[0] if len(self.codes) else np.zeros(0, np.int64)

    def matches(self, block: Block) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, word in document, word in item, words) of every longest verbatim match of a window or more."""
        if not len(block.suffix) or not len(self.codes):
            return
        low, high = search(self.codes, self.suffixes, block.wanted, block.length)
        some = np.flatnonzero(high > low)
        if not some.size:
            return
        size = (high - low)[some]
        of = np.repeat(some, size)
        at = self.suffixes[np.repeat(low[some], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        row = self.owner[at]
        inside, own = at - row - self.first[row], block.suffix[of] - block.first[block.item[of]]
        shift = inside - own
        sort = np.lexsort((own, shift, block.item[of], row))
        of, row, inside, own, shift = of[sort], row[sort], inside[sort], own[sort], shift[sort]
        item = block.item[of]
        new = np.ones(len(of), bool)
        new[1:] = (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(shift) != 0) | (np.diff(own) != 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(of)) - 1
        for h, t in zip(heads, tails):
            length = int(own[t] - own[h] + block.length[of[t]])
            r, i = int(row[h]), int(item[h])
            yield from self._same(block, r, i, int(inside[h]), int(own[h]), length)

    def _same(self, block: Block, row: int, item: int, inside: int, own: int, length: int):
        """The match if its words are equal as text too (equal hashes of different words are cut out)."""
        a, b = self.first[row] + inside, block.first[item] + own
        table, run = lower_table(), 0
        for k in range(length + 1):
            same = k < length and table[self.data[self.start[a + k] : self.end[a + k]]].tobytes() == block.low[block.start[b + k] : block.end[b + k]]
            if same:
                run += 1
            elif run:
                if run >= min(int(block.length[block.item == item][0]), length):
                    yield row, item, inside + k - run, own + k - run, run
                run = 0


def digest(ids: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items_sha256, contaminated, spans (item_id, doc_word, item_word, words).

    Words are runs of letters, digits and characters beyond ASCII, with A-Z lowered.  ``n_hit`` counts the document
    words inside any occurrence of a window; a row is contaminated if these are at least a twentieth of its words.
    Null and empty texts have no words and are clean; so is everything if the benchmark is empty.  Repeated rows and
    ids give a row each; a null id stays null; null item ids count as ''; other columns are not read.
    """
    blocks = blocks_of(benchmark, item_col, item_text, window, block_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for i, j in slices(offsets, shard_bytes):
                found = scan_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], blocks, window)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *[pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), spans))]],
                    [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    schema = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<item_id:string,doc_word:int,item_word:int,words:int>>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def scan_rows(data: np.ndarray, offsets: np.ndarray, blocks: list, window: int) -> list[tuple]:
    """(n_words, n_hit, n_items, digest, contaminated, spans) of each row of one shard."""
    shard = Shard(data, offsets, window)
    spans: dict[int, list] = {}
    for block in blocks:
        test = block.value
        for row, item, inside, own, length in shard.matches(test):
            spans.setdefault(row, []).append((test.ids[item], inside, own, length))
    none, out = digest(set()), []
    for row, n in enumerate(shard.count.tolist()):
        got = spans.get(row)
        if not got:
            out.append((n, 0, 0, none, False, []))
            continue
        covered = np.zeros(n + 1, np.int64)
        for _, inside, _, length in got:
            covered[inside] += 1
            covered[inside + length] -= 1
        hit, ids = int((np.cumsum(covered) > 0).sum()), {s[0] for s in got}
        out.append((n, hit, len(ids), digest(ids), 20 * hit >= n, [dict(zip(("item_id", "doc_word", "item_word", "words"), s)) for s in sorted(got)]))
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text",
                        item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that are not contaminated (see ``scan``), with all their columns."""
    blocks = blocks_of(benchmark, item_col, item_text, window, BLOCK_BYTES)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            for i, j in slices(offsets, SHARD_BYTES):
                found = scan_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], blocks, window)
                yield batch.slice(i, j - i).filter(pa.array([not r[4] for r in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
cut AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS key FROM pos, sizes WHERE p + n - 1 <= len(w)),
hit AS (SELECT doc_id, p, cut.n, item_id FROM cut JOIN win ON win.n = cut.n AND win.key = cut.key),
cover AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
