"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Every word occurrence is a suffix: the words from there to the end of its piece, five at most.  Partitions by the first
one and two words are settled for the whole corpus first: one pass counts the words, a second one the pairs of frequent
words by a hash (5 bytes a pair and slice), and a phrase that holds a rare word or pair is rare.  The third pass cuts each
suffix before its first rare pair (bit maps of bounded size, whose false positives only let more through) and counts
equal suffixes of a slice once.  Suffixes are routed globally by their leading words, and each route is sorted by the
multikey quicksort: a segment is split by one word into smaller, equal and larger; the weight of the equal part is the
count of that phrase and it is split further by the next word; parts lighter than the least count are abandoned at once.

Routing takes two leading words, or more while all of them are words that many suffixes begin with: a phrase with one
less frequent word is no more frequent than that, so no route is much larger than the others.  Shorter phrases of such
words are counted by every route that holds a part of them and added up.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.arrow import lower_table, mask, mix, slices, text_buffer, words
from graphloom.llm.components import written

#: Text of a slice, and suffixes of a route (about).
SLICE_BYTES, ROUTE_SUFFIXES = 4 << 20, 1 << 20
#: Bits of the maps of frequent words (2 MB) and pairs (8 MB), and the largest number of routes; heavy words are at most
#: as many.
MAP_BITS, PAIR_BITS, ROUTES = 24, 26, 1 << 20
BREAK = mask(lambda b: chr(b) in ".,;:!?\n\x0b\x0c\r")
IN_WORD = mask(lambda b: chr(b) not in " \t.,;:!?\n\x0b\x0c\r")
NO_LANG = "und"


class Slice:
    """The words of a slice of texts, one after the other with a blank behind each, and where their pieces end."""

    def __init__(self, column, langs: np.ndarray, tag: np.ndarray):
        data, offsets = text_buffer(column)
        data = lower_table()[data]
        start, end, row, code = words(data, offsets, IN_WORD)
        self.n = len(start)
        if not self.n:
            return
        breaks = np.cumsum(BREAK[data], dtype=np.int32)
        ends_piece = np.ones(self.n, bool)
        ends_piece[:-1] = (row[1:] != row[:-1]) | (breaks[start[1:]] != breaks[end[:-1] - 1])
        last = np.flatnonzero(ends_piece)
        #: last word of the piece of each word
        self.last = last[np.searchsorted(last, np.arange(self.n))]
        lens = end - start
        at = np.concatenate([[0], np.cumsum(lens + 1)])
        text = np.full(int(at[-1]), 32, np.uint8)
        keep = np.ones(int(at[-1]), bool)
        keep[at[1:] - 1] = False
        text[keep] = data[IN_WORD[data]]
        self.text, self.at, self.lang = text, at, langs[row]
        #: 64-bit hash of word and language
        self.code = mix(code ^ tag[self.lang])


def _hash_of(names: list[str]) -> np.ndarray:
    data, offsets = text_buffer(pa.array(names, pa.string()))
    out = np.zeros(len(names), np.uint64)
    every = np.ones(256, bool)
    _, _, row, code = words(data, offsets, every)
    out[row] = code
    return out


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Slice]]:
    """Slices of (lang, text) batches, with the names of their languages."""
    for batch in batches:
        column = batch.column(1)
        _, offsets = text_buffer(column)
        for i, j in slices(offsets, SLICE_BYTES):
            coded = batch.column(0).slice(i, j - i).dictionary_encode()
            names = coded.dictionary.to_pylist()
            part = Slice(column.slice(i, j - i), coded.indices.to_numpy(zero_copy_only=False), _hash_of(names))
            if part.n:
                yield names, part


def _strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def _gather(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings text[start:end]."""
    lens = end - start
    offsets = np.concatenate([[0], np.cumsum(lens)])
    index = np.arange(int(offsets[-1])) + np.repeat(start - offsets[:-1], lens)
    return _strings(offsets, text[index])


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text), over all rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, part in _each(batches):
            every = _strings(part.at, part.text)
            for lang, name in enumerate(names):
                own = every if len(names) == 1 else every.filter(pa.array(part.lang == lang))
                counts = own.value_counts()
                word = pc.utf8_slice_codeunits(counts.field(0).cast(pa.string()), 0, stop=-1)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(word), pa.string()), word, counts.field(1).cast(pa.int64())], ["lang", "word", "n"])

    return docs.mapInArrow(scan, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_hashes(frequent: DataFrame) -> DataFrame:
    """(h) of (lang, word): the hash that a slice gives the word."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = _hash_of(["" if x is None else x for x in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(mix(_hash_of(batch.column(1).to_pylist()) ^ tags).view(np.int64))], ["h"])

    return frequent.select("lang", "word").mapInArrow(scan, "h long")


def _marked(bits: np.ndarray, code: np.ndarray, width: int) -> np.ndarray:
    cell = (code >> np.uint64(64 - width)).astype(np.int64)
    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1


def _pairs(part: Slice, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the pairs of neighbouring frequent words inside a piece."""
    frequent = _marked(known, part.code, MAP_BITS)
    at = np.flatnonzero(frequent[:-1] & frequent[1:] & (part.last[:-1] > np.arange(part.n - 1)))
    return at, mix(part.code[at] * np.uint64(0x9E3779B97F4A7C15) + part.code[at + 1])


def frequent_pairs(docs: DataFrame, known: np.ndarray, least: int, routes: int, tasks: int) -> np.ndarray:
    """Packed bit map over the hashes of pairs that may occur ``least`` times or more.

    Pairs are dealt by the top bits of their hash; of the rest 32 bits are kept, so that different pairs may share a
    count: it is never too low.  A bucket gives its stretch of the map, so the driver gets the map and no more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)
    top = min(max(8, (routes - 1).bit_length()), PAIR_BITS - 3)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _each(batches):
            _, code = _pairs(part, shared.value)
            code, n = np.unique(code >> np.uint64(32 - top), return_counts=True)
            bucket = (code >> np.uint64(32)).astype(np.int64)
            heads = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(heads[1:], len(code))
            low, n = (code & np.uint64(0xFFFFFFFF)).astype("<u4"), np.minimum(n, least).astype("<u4" if least > 255 else "u1")
            yield pa.RecordBatch.from_arrays([pa.array(bucket[heads].astype(np.int32)), pa.array([low[i:j].tobytes() for i, j in zip(heads, ends)], pa.binary()),
                                              pa.array([n[i:j].tobytes() for i, j in zip(heads, ends)], pa.binary())], ["bucket", "low", "n"])

    def bits(low: list[bytes], n: list[bytes]) -> bytes:
        cells, at = np.unique(np.frombuffer(b"".join(low), "<u4"), return_inverse=True)
        weight = np.bincount(at, np.frombuffer(b"".join(n), "<u4" if least > 255 else "u1").astype(np.float64))
        out = np.zeros(1 << (PAIR_BITS - top), bool)
        out[cells[weight >= least].astype(np.int64) >> (32 - (PAIR_BITS - top))] = True
        return np.packbits(out).tobytes()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, low, n = None, [], []
        for batch in batches:
            for b, x, y in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if b != bucket:
                    if low:
                        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([bits(low, n)], pa.binary())], ["bucket", "bits"])
                    bucket, low, n = b, [], []
                low.append(x)
                n.append(y)
        if low:
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([bits(low, n)], pa.binary())], ["bucket", "bits"])

    found = docs.mapInArrow(scan, "bucket int, low binary, n binary").repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(add, "bucket int, bits binary")
    out, step = np.zeros(1 << (PAIR_BITS - 3), np.uint8), 1 << (PAIR_BITS - 3 - top)
    for bucket, stretch in found.collect():
        out[bucket * step : (bucket + 1) * step] = np.frombuffer(stretch, np.uint8)
    return out


def suffixes(docs: DataFrame, depth: int, routes: int, known: np.ndarray, pairs: np.ndarray, heavy: np.ndarray) -> DataFrame:
    """(route, lang, suffix array<string>, n array<long>): suffixes of two words or more, equal ones of a slice once.

    ``known`` and ``pairs`` are the packed bit maps of frequent words and pairs, ``heavy`` the sorted hashes of the words
    that alone don't route.  A route is (words that settle it, number), packed as one number.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known, pairs, heavy))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, pair_bits, leaders = shared.value
        for names, part in _each(batches):
            at, code = _pairs(part, bits)
            linked = np.zeros(part.n, bool)
            linked[at[_marked(pair_bits, code, PAIR_BITS)]] = True
            stops = np.flatnonzero(~linked)
            #: words of each suffix: up to the first word without a frequent pair to the next, ``depth`` at most
            from_ = np.flatnonzero(linked)
            if not from_.size:
                continue
            length = np.minimum(stops[np.searchsorted(stops, from_)] - from_ + 1, depth)
            leads = np.zeros(part.n, bool)
            if leaders.size:
                at = np.searchsorted(leaders, part.code)
                at[at == len(leaders)] = 0
                leads = leaders[at] == part.code
            settled, hash_ = np.full(from_.size, 0, np.int64), np.zeros(from_.size, np.uint64)
            light = np.zeros(from_.size, bool)
            for k in range(depth):
                open_ = np.flatnonzero((settled == 0) & (length > k))
                if not open_.size:
                    break
                word = from_[open_] + k
                hash_[open_] = mix(hash_[open_] * np.uint64(0x9E3779B97F4A7C15) + part.code[word])
                light[open_] |= ~leads[word]
                done = (light[open_] | (length[open_] == k + 1)) & (k >= 1)
                settled[open_[done]] = np.where(light[open_[done]], k + 1, depth)
            route = settled * (ROUTES * 2) + (hash_ % np.uint64(routes)).astype(np.int64)
            found = _gather(part.text, part.at[from_], part.at[from_ + length] - 1)
            lang = part.lang[from_]
            for code in np.unique(lang).tolist():
                own = np.flatnonzero(lang == code)
                coded = (found if len(own) == len(found) else found.take(pa.array(own))).dictionary_encode()
                ids = coded.indices.to_numpy(zero_copy_only=False)
                n = np.bincount(ids, minlength=len(coded.dictionary))
                to = np.empty(len(n), np.int64)
                to[ids] = route[own]
                sort = np.argsort(to, kind="stable")
                heads = np.flatnonzero(np.diff(to[sort], prepend=-1))
                bounds = pa.array(np.append(heads, len(sort)).astype(np.int32))
                text = coded.dictionary.cast(pa.string()).take(pa.array(sort))
                yield pa.RecordBatch.from_arrays([
                    pa.array(to[sort][heads]), pa.array([names[code]] * len(heads), pa.string()),
                    pa.ListArray.from_arrays(bounds, text), pa.ListArray.from_arrays(bounds, pa.array(n[sort].astype(np.int64)))], ["route", "lang", "suffix", "n"])

    return docs.mapInArrow(scan, "route long, lang string, suffix array<string>, n array<long>")


def quicksort(keys: np.ndarray, weight: np.ndarray, least: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Multikey three-way quicksort of the rows of ``keys`` (codes by place; -1 after the end): (row, places, weight) of
    every prefix whose weight is ``least[places]`` or more; lighter segments are abandoned."""
    rows, places, weights = [], [], []
    stack = [(np.arange(len(keys)), 0)]
    while stack:
        segment, k = stack.pop()
        word = keys[segment, k]
        if word.min() < 0:
            segment = segment[word >= 0]
            if not segment.size:
                continue
            word = keys[segment, k]
        pivot = word[len(word) >> 1]
        if len(word) > 64:
            pivot = np.partition(word[:: len(word) >> 5], 16)[16]
        for side in (word < pivot, word > pivot):
            if side.any() and weight[part := segment[side]].sum() >= least[k + 1]:
                stack.append((part, k))
        equal = segment[word == pivot]
        total = int(weight[equal].sum())
        if total >= least[k + 1]:
            rows.append(int(equal[0]))
            places.append(k + 1)
            weights.append(total)
            if k + 1 < keys.shape[1]:
                stack.append((equal, k + 1))
    return rows, places, weights


def phrase_counts(routed: DataFrame, depth: int, least: int, tasks: int) -> DataFrame:
    """(lang, phrase, words, n) of all phrases of two words or more with n >= least."""

    def one(settled: int, langs: list[str], lists: list[pa.Array], counts: list[pa.Array]) -> pa.RecordBatch:
        coded = pa.array(langs, pa.string()).dictionary_encode()
        lang = np.repeat(coded.indices.to_numpy(zero_copy_only=False), [len(x) for x in lists])
        text = pa.concat_arrays(lists)
        parts = pc.split_pattern(text, " ")
        lens = np.diff(np.asarray(parts.offsets))
        flat = parts.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        keys = np.full((len(text), depth + 1), -1, np.int32)
        keys[:, 0] = lang
        row = np.repeat(np.arange(len(text)), lens)
        keys[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens) + 1] = flat
        weight = np.concatenate([np.asarray(c) for c in counts])
        #: prefixes shorter than what settles the route lie on several routes: any weight counts
        rows, places, weights = quicksort(keys, weight, [1, 1] + [1 if k < settled else least for k in range(1, depth + 1)])
        rows, places, weights = np.array(rows, np.int64), np.array(places), np.array(weights, np.int64)
        kept = places >= 3
        rows, k, weights = rows[kept], places[kept] - 1, weights[kept]
        starts = np.asarray(parts.offsets)[:-1][rows]
        picked = parts.flatten().take(pa.array(np.repeat(starts - np.concatenate([[0], np.cumsum(k)[:-1]]) if len(k) else starts, k) + np.arange(int(k.sum()))))
        bounds = np.concatenate([[0], np.cumsum(k)]).astype(np.int32)
        phrase = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), picked), " ")
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(lang[rows])), phrase, pa.array(k.astype(np.int32)), pa.array(weights)], ["lang", "phrase", "words", "n"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, langs, lists, counts = None, [], [], []
        for batch in batches:
            for i, r in enumerate(batch.column(0).to_pylist()):
                if r != route:
                    if lists:
                        yield one(route // (ROUTES * 2), langs, lists, counts)
                    route, langs, lists, counts = r, [], [], []
                langs.append(batch.column(1)[i].as_py())
                lists.append(batch.column(2)[i].values)
                counts.append(batch.column(3)[i].values)
        if lists:
            yield one(route // (ROUTES * 2), langs, lists, counts)

    found = routed.repartition(tasks, "route").sortWithinPartitions("route").mapInArrow(sort, "lang string, phrase string, words int, n long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _part(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("w", first, length), " ")


def mine(docs: DataFrame, depth: int = 5, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases of 2 to ``depth`` words.

    Words are runs without blank and tab, with A-Z lowered, in the pieces between ``.,;:!?`` and line ends; a phrase
    lies inside one piece.  a, l and r count the phrase and the two parts of its lowest-scoring cut, n all words of the
    language; the score is floor(1000 a n / (l r)).  A phrase goes if a longer candidate that holds it is as frequent.
    Null texts are empty, a null language is ``und``; repeated rows count as often as they occur, ties go by count and
    phrase; an empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    vocabulary = written(word_counts(rows), "phrase-words")
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("total"))
    size = vocabulary.agg(F.sum("n")).first()[0] or 0
    frequent = vocabulary.where(F.col("n") >= least)
    routes = int(min(max(8, size // ROUTE_SUFFIXES), ROUTES))
    cells = word_hashes(frequent).select(F.shiftrightunsigned("h", 64 - MAP_BITS).cast("int").alias("c")).distinct().toArrow()["c"].to_numpy()
    bits = np.zeros(1 << MAP_BITS, bool)
    bits[cells] = True
    # words of more than a route's share: fewer than ROUTES of them
    heavy = np.sort(word_hashes(frequent.where(F.col("n") > max(size // routes, least))).toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64))
    tasks = max(routes, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = np.packbits(bits)
    pairs = frequent_pairs(rows, known, least, routes, tasks)
    phrases = written(phrase_counts(suffixes(rows, depth, routes, known, pairs, heavy), depth, least, tasks), "phrases")

    parts = phrases.withColumn("w", F.split("phrase", " "))
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: _part(i, k)))))
    covered = parts.where(F.col("words") > 2).select("lang", inner.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = parts.join(covered, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 100 * n").select("lang", "phrase", "words", "w", F.col("n").alias("a"))
    cut = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    counts = frequent.select("lang", F.col("word").alias("part"), "n").unionByName(phrases.select("lang", F.col("phrase").alias("part"), "n"))
    scored = (cut.join(counts.select("lang", F.col("part").alias("left"), F.col("n").alias("l")), ["lang", "left"])
              .join(counts.select("lang", F.col("part").alias("right"), F.col("n").alias("r")), ["lang", "right"])
              .join(totals, "lang"))
    wide = "CAST({} AS DECIMAL(17,0))"
    score = F.expr(f"CAST(1000 AS DECIMAL(4,0)) * {wide.format('a')} * {wide.format('total')} div ({wide.format('l')} * {wide.format('r')})")
    worst = scored.withColumn("score", score).groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    flat = worst.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB, from all word n-grams.
ORACLE = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
split AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
gram AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
    FROM split, (SELECT unnest(generate_series(1, 5)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, phrase, k, count(*) AS n FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS total FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE n >= 100),
inner_ AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(n) AS longer
  FROM (SELECT lang, w, n, m, unnest(generate_series(1, k - m + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM often WHERE k > 2)) GROUP BY ALL),
kept AS (SELECT o.* FROM often o LEFT JOIN inner_ i ON o.lang = i.lang AND o.phrase = i.phrase WHERE o.k >= 2 AND (i.longer IS NULL OR 100 * i.longer < 100 * o.n)),
cut AS (SELECT lang, phrase, n AS a, c, array_to_string(w[1:c], ' ') AS lp, array_to_string(w[c + 1:], ' ') AS rp FROM (SELECT *, unnest(generate_series(1, k - 1)) AS c FROM kept)),
scored AS (SELECT cut.lang, cut.phrase, a, c, l.n AS l, r.n AS r, total, (1000::HUGEINT * a * total) // (l.n::HUGEINT * r.n) AS score
  FROM cut JOIN often l ON l.lang = cut.lang AND l.phrase = lp JOIN often r ON r.lang = cut.lang AND r.phrase = rp JOIN total t ON t.lang = cut.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, total AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
