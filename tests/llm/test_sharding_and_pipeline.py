"""Shards against a full sort, and the pipeline's stages against their brute-force versions."""
import collections
import hashlib
import zlib

import public_tokenizers as P
import pytest

import corpus_pipeline
from graphloom.llm import byte_bpe, queries, sharding
from helpers import SCHEMA, components, contamination, corpus, ordered

SF = "/root/testdata/sf0.001"


def full_sort(rows, n, tolerance=sharding.TOLERANCE):
    def key(r):
        return (-1 if r[1] is None else int(hashlib.md5(r[1].encode()).hexdigest()[:15], 16), sharding.LOWEST if r[0] is None else r[0])

    def size(r):
        return len((r[1] or "").encode()) + 1

    def borders(part):
        out, sum_, last = [], 0, None
        for r in rows:
            if last is None or part(r) != last:
                out.append(sum_)
                last = part(r)
            sum_ += size(r)
        return [*out, sum_]

    def near(points, t):
        under = max(x for x in points if x <= t)
        over = min((x for x in points if x > t), default=under)
        return under if t - under <= over - t else over

    rows = sorted(rows, key=key)
    total, texts, units = sum(map(size, rows)), borders(lambda r: key(r)[0]), borders(key)
    cuts = []
    for j in range(1, n):
        t = total * j / n
        cuts.append(near(texts, t) if abs(near(texts, t) - t) <= tolerance * total / n else near(units, t))
    out, below, sum_, last, slots = [], 0, 0, None, collections.Counter()
    for r in rows:
        if key(r) != last:
            below, last = sum_, key(r)
        s = sum(c <= below for c in cuts)
        out.append((r[0], size(r), zlib.crc32((r[1] or "").encode()), s, slots[s]))
        slots[s] += 1
        sum_ += size(r)
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_shards(spark, hot):
    rows = corpus()
    if hot:
        rows += [(1000 + i, "the same words " * 20, None, None, None, None, None, None) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shard(docs, 8).collect()
    assert ordered(got) == ordered(full_sort(rows, 8))
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    if hot:
        assert sum(sizes[s] for s in range(8)) == sum(len((r[1] or "").encode()) + 1 for r in rows)
    assert sharding.shard(docs.limit(0), 8).count() == 0


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    bench = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.schema == docs.schema, name
        before, after = [(r.doc_id, r.text) for r in docs.collect()], {r.doc_id for r in kept.collect()}
        if name == "near_duplicates":
            assert after == {c for _, _, c in components(before, 5, 80, 100)}
        if name == "decontamination":
            assert after == {i for i, t in before if not contamination(t, bench)[4]}
        assert len(after) >= 0.7 * len(before), name
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    tool, _ = byte_bpe.transducer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for r in last:
        assert r.n_tokens == len(tool.encode(texts[r.doc_id]))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert ordered(corpus_pipeline.run(spark, SF).collect()) == ordered(last)


def test_stages_take_awkward_rows(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    for docs in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).schema == docs.schema, name
            stage(spark, docs, SF).count()
