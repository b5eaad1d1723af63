"""Language, toxicity, licences and the context-mixing scores: held-out accuracy, exact parts, awkward rows."""
import collections
import math
import random
import textwrap
import zlib

import numpy as np
import pytest
import regex

from graphloom.llm import langid, license_scan, mixing_lm, queries, toxicity
from helpers import LOWER, SCHEMA, SPACED, corpus

SF = "/root/testdata/sf0.01"


def held_out(i, m=5, k=0):
    return zlib.crc32(str(i).encode()) % m == k


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in queries.table(spark, SF, "documents").collect()}
    got = queries.REGISTRY["op9_language_id"](spark, SF).collect()
    assert len(got) == len(truth)
    apart = [r for r in got if r.held_out]
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in apart]) >= 0.97


def test_language_mixture(spark):
    en, fr = "the cat sat on the mat and looked at the dog with that ", "le chat est sur la table et il regarde le chien avec une "
    rows = [(i, en * 8, "en") for i in range(20)] + [(100 + i, fr * 8, "fr") for i in range(20)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    data = (en * 3 + fr * 9).encode()
    share, _ = model.mixtures(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert share[0].argmax() == model.names.index("fr") and 0.1 < share[0].min() < 0.45


def test_language_awkward_rows(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model = langid.learn(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == docs.count()
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {4, 5, 6, 8} <= und
    kept = langid.keep_identified(docs, model)
    assert kept.schema == docs.schema and not und & {r.doc_id for r in kept.collect()} - {None}
    nothing = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in queries.table(spark, SF, "labels").collect()}
    got = queries.REGISTRY["op5_toxicity"](spark, SF).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    apart = [(labels[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in labels]
    ones, zeros = [s for y, s in apart if y], [s for y, s in apart if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]) >= 0.9


def test_toxicity_awkward_rows(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs, none)
    got = toxicity.predict(docs, model).collect()
    assert len(got) == docs.count() and len({r.score for r in got}) == 1
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, 0), (7, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    kept = toxicity.keep_clean(docs, model)
    assert kept.schema == docs.schema
    assert toxicity.predict(docs.limit(0), model).count() == 0


def test_disguised_words_are_seen():
    lexicon = toxicity.Lexicon({})
    plain, hidden = toxicity.features("you are an idiot", lexicon), toxicity.features("you are an 1d1ot i.d.i.o.t idiiiot", lexicon)
    at = toxicity.NAMES.index
    assert plain[at("hits")] > 0 and plain[at("near_you")] > 0
    assert hidden[at("masked_hits")] > 0 and hidden[at("runs")] > 0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    knots, values = toxicity.isotonic(x, (rng.random(300) < 1 / (1 + np.exp(-2 * x))).astype(float))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()


def wrapped(texts, lead="", width=70):
    """The texts as paragraphs of a comment: wrapped lines behind a mark, a line with the mark alone between them."""
    return ("\n" + lead.rstrip() + "\n").join("\n".join(lead + line for line in textwrap.wrap(t, width - len(lead))) for t in texts)


def plain_scan(text):
    """(n_licences, families, n_unconfirmed) by loops over the pieces of one text."""
    model = license_scan.classifier()
    templates = [(f, set(license_scan.grams_of(license_scan.words_of(t))), len(license_scan.words_of(t))) for f, t in license_scan.TEMPLATES]
    short = [g for _, g, n in templates if n <= license_scan.ONE_LINE]
    every = set().union(*(g for _, g, _ in templates))
    found, before = [], None  # runs as [first, last, words]
    for at, piece in enumerate(regex.split(license_scan.PIECES, text or "")):
        words = license_scan.words_of(piece)
        grams = set(license_scan.grams_of(words))
        two = [f"{a} {b}" for a, b in zip(words, words[1:])]
        known = sum(p in every for p in two)
        strong = known >= 2 and (2 * known >= len(two) or max(len(grams & t) / len(t) for t in short) >= 0.6)
        few = 1 <= len(words) <= license_scan.FEW and grams <= every
        alone = known >= 2 and max(len(grams & t) / len(grams | t) for t in short) >= 0.6 and bool(regex.search(r"[.!?]\W*$|SPDX-", piece))
        if not (strong or few):
            before = None
            continue
        if before is None or alone or before == "alone":
            found.append([at, at, []])
        found[-1][1] = at
        found[-1][2].extend(words)
        before = "alone" if alone else "run"
    got = []
    for first, last, words in found:
        grams = license_scan.grams_of(words)
        p = model.probabilities(grams)
        best = max(range(1, len(p)), key=lambda c: p[c])
        if len(words) < license_scan.FEW or p[best] <= p[0] or p[best] < license_scan.LEAST:
            got.append((first, last, None, False))
            continue
        family, own = model.classes[best], set(grams)
        sure = any(f == family and (len(own & t) / len(t) >= 0.6 or len(own) >= license_scan.INSIDE_GRAMS and len(own & t) / len(own) >= 0.8) for f, t, _ in templates)
        got.append((first, last, family, sure))
    if not got or got[0][0] > 0:
        got.insert(0, (0, 0, None, False))
    parts = {i for i in range(len(got) - 1) if got[i][2] == license_scan.RESERVED and got[i][3] and got[i + 1][3] and got[i + 1][2] != license_scan.RESERVED
             and got[i + 1][0] - got[i][1] <= license_scan.APART}
    got = [g for i, g in enumerate(got) if g[2] and i not in parts]
    return sum(g[3] for g in got), ",".join(sorted({g[2] for g in got if g[3]})), sum(not g[3] for g in got)


def notices():
    """(family, texts): whole headers by family, from the notices of more than one line."""
    long = {}
    for f, t in license_scan.TEMPLATES:
        if len(license_scan.words_of(t)) > license_scan.ONE_LINE:
            long.setdefault(f, []).append(t)
    yield "MIT", ["MIT License", "Copyright (c) 2019 Jane Doe", *long["MIT"]]
    yield "BSD", ["Copyright (c) 2019, Jane Doe All rights reserved.", *long["BSD"]]
    yield "BSD", long["BSD"][1:2]
    yield "Apache-2.0", ["Copyright 2020 The Authors", long["Apache-2.0"][0], "http://www.apache.org/licenses/LICENSE-2.0", long["Apache-2.0"][2]]
    yield "GPL", long["GPL"][:1]
    yield "GPL", long["GPL"][1:]
    yield "LGPL", long["LGPL"]
    yield "LGPL", long["LGPL"][1:2]
    yield "MPL-2.0", long["MPL-2.0"][-1:]
    yield "ISC", ["Copyright (c) 2001 Bob", *long["ISC"]]
    yield "Proprietary", ["Copyright (c) 2001 Foo Corp. All rights reserved."]


def test_wrapped_licences(spark):
    before = "The cat sat on the mat in the sun and looked at the river\n"
    cases = [(f, pre + wrapped(t, lead, width)) for f, t in notices() for lead, width in (("", 70), (" * ", 78), ("# ", 60), ("// ", 50), ("", 1000)) for pre in ("", before)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[i].families for i in range(len(cases))] == [f for f, _ in cases]
    assert [(got[i].n_licences, got[i].families, got[i].n_unconfirmed) for i in range(len(cases))] == [plain_scan(t) for _, t in cases]


def test_licences_by_brute_force(spark):
    """The given documents, the awkward rows with clashing columns, and a very long text."""
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_licences, r.families, r.n_unconfirmed) for r in license_scan.scan(docs).collect())
    assert got == sorted((i, *plain_scan(t)) for i, t in rows)
    notice = license_scan.TEMPLATES[0][1]
    more = [(500, "the cat sat. " * 100_000 + "\n" + notice), (501, (notice + "\n") * 2_000)]
    names = ["row", "id", "pos", "words", "run", "family", "last"]
    rows = [r[:2] for r in corpus()] + more
    wide = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    got = sorted((repr(r.doc_id), r.n_licences, r.families, r.n_unconfirmed) for r in license_scan.scan(wide).collect())
    assert got == sorted((repr(i), *plain_scan(t)) for i, t in rows)
    assert ("500", 1, "MIT", 0) in got and ("501", 2_000, "MIT", 0) in got


def test_licences(spark):
    rows = [(1, "Some prose here.\nLicensed under the Apache License, Version 2.0.\nMore."), (2, "the general public was under the bridge"),
            (3, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (None, None), (5, ""), (5, ""),
            (6, "This work is licensed under the GNU General Public License, version 3.\n" * 3), (7, "licence " * 50)]
    got = sorted(((r.doc_id or 0), r.n_licences, r.families) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, ""), (1, 1, "Apache-2.0"), (2, 0, ""), (3, 2, "CC,MIT"), (5, 0, ""), (5, 0, ""), (6, 3, "GPL"), (7, 0, "")]
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licence_probabilities_equal_the_plain_model(spark):
    model = license_scan.classifier()
    rows = list(enumerate(t for _, t in license_scan.TEMPLATES))
    found = license_scan.scan_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.id: r for r in found if r.paragraph == 0}
    for i, line in rows:
        if len(regex.split(license_scan.PIECES, line)) > 1:
            continue
        p = model.probabilities(license_scan.grams_of(license_scan.words_of(line)))
        best = max(range(1, len(p)), key=lambda c: p[c])
        assert got[i].family == model.classes[best] == license_scan.TEMPLATES[i][0]
        assert got[i].probability == pytest.approx(p[best], abs=1e-6)
    assert all(model.classes[int(np.argmax(model.probabilities(grams)))] == f for f, grams in model.left_out if f == license_scan.UNKNOWN)


def base_scores(rows, learned):
    tokens = lambda t: [*SPACED.findall((t or "").translate(LOWER)), None]
    counts = collections.Counter(w for t in learned for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    for i, t in rows:
        w = tokens(t)
        yield i, len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)


@pytest.mark.parametrize("heads", [1 << 18, 10])
def test_base_scores(spark, monkeypatch, heads):
    monkeypatch.setattr(mixing_lm, "HEAD_WORDS", heads)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    learned = [r[1] for r in rows if not held_out(r[0] if r[0] is not None else "", 7, 2)]
    model, counts = mixing_lm.learn(docs.where(queries.remainder(7) != 2))
    got = sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in mixing_lm.score(docs, model, counts).collect())
    exp = sorted((repr(i), a, b, c, round(s, 6)) for i, a, b, c, s in base_scores([r[:2] for r in rows], learned))
    assert [g[:4] for g in got] == [e[:4] for e in exp]
    assert all(g[4] == pytest.approx(e[4], abs=1e-5) for g, e in zip(got, exp))


def test_mixing_without_training_rows(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model, counts = mixing_lm.learn(docs.limit(0))
    got = mixing_lm.score(docs, model, counts).collect()
    assert len(got) == docs.count()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 and math.isfinite(r.score) for r in got)


def test_mixing_prefers_what_it_learned(spark):
    rows = [(i, "the harbour pilot boards the ship at dawn") for i in range(30)]
    model, counts = mixing_lm.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    docs = spark.createDataFrame([(1, rows[0][1]), (2, "qzx vvkj wqpf jjjk zzq xkcd wvu bqqt")], "doc_id long, text string")
    got = {r.doc_id: r.bits_per_byte for r in mixing_lm.score(docs, model, counts).collect()}
    assert got[1] < 1 < 3 < got[2]


def test_word_probabilities_are_proper():
    """The spelled words of one byte and their ends share the mass that the code leaves them: sums stay at 1 or below."""
    code = mixing_lm.Code(np.ones(256))
    tables = np.random.default_rng(3).normal(size=(mixing_lm.ORDERS, 1 << mixing_lm.SLOT_BITS)).astype(np.float32)
    gate = np.zeros(1 << mixing_lm.SLOT_BITS, np.uint8)
    model = mixing_lm.Model(code, tables, gate, [np.full((mixing_lm.GATES, mixing_lm.ORDERS + 1), 0.2)], np.zeros(0), np.zeros(0), 0, 0, 0)
    every = [bytes((b,)) for b in range(256)]
    assert (10 ** model.spell(every)).sum(0) == pytest.approx(1.0, abs=1e-4)


def test_mixing_reads_over_word_borders_and_learns_along_the_text(spark, monkeypatch):
    """The order of the words counts, and the weights of a document change as it goes on."""
    rng = random.Random(5)
    follow = {}
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    for w in vocabulary:
        follow[w] = rng.sample(vocabulary, 2)

    def fluent(n):
        out = [rng.choice(vocabulary)]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return out

    model, counts = mixing_lm.learn(spark.createDataFrame([(i, " ".join(fluent(100))) for i in range(80)], "doc_id long, text string"))
    words = fluent(300)
    mixed = words[:]
    rng.shuffle(mixed)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(mixed))], "doc_id long, text string")
    got = {r.doc_id: r.bits_per_byte for r in mixing_lm.score(docs, model, counts).collect()}
    assert got[1] < 0.7 * got[2]

    hashes = np.arange(1, len(vocabulary) + 1, dtype=np.uint64)
    index = np.array([vocabulary.index(w) for w in mixed])

    def along():
        choices, walk = [], mixing_lm.Walk(np.zeros(len(index), np.int64), index, 1, hashes, [w.encode() for w in vocabulary])
        model.spell(walk.spelled, choices)
        return model.along(walk, 1, np.zeros(len(walk.index)), choices)[0]

    learned = along()
    monkeypatch.setattr(mixing_lm, "STEP", 0.0)
    assert learned > along() + 1


def test_scores_do_not_depend_on_the_number_of_head_words(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    found = []
    for heads in (1 << 18, 10):
        monkeypatch.setattr(mixing_lm, "HEAD_WORDS", heads)
        model, counts = mixing_lm.learn(docs.where(queries.remainder(7) != 2))
        found.append(sorted((repr(r.doc_id), r.score) for r in mixing_lm.score(docs, model, counts).collect()))
    assert [f[0] for f in found[0]] == [f[0] for f in found[1]]
    assert [f[1] for f in found[0]] == pytest.approx([f[1] for f in found[1]], rel=1e-6)


def test_disguised_words_count_whatever_else_the_text_holds(monkeypatch):
    """Features are the same with the quick tests before the patterns and without them."""
    lexicon = toxicity.Lexicon({})
    masked, hits, runs = (toxicity.NAMES.index(k) for k in ("masked", "masked_hits", "runs"))
    rng = random.Random(3)
    alone = ["f**k", "st**id", "id!0t", "a$$hole", "1d10t", "s.t.u.p.i.d", "Iiidiot", "Ttt", "Ééé", "sTuUupid"]
    texts = alone + ["".join(rng.choice("aAbé0*!.-_ ß") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    got = [toxicity.features(t, lexicon) for t in texts]
    assert all(g[masked] > 0 for g in got[:6]) and all(g[runs] > 0 for g in got[6:10])
    assert got[2][hits] > 0 and got[6][hits] > 0
    monkeypatch.setattr(toxicity, "may_mask", lambda signs: True)
    monkeypatch.setattr(toxicity, "may_run", lambda low: True)
    assert got == [toxicity.features(t, lexicon) for t in texts]
