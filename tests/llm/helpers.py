"""Small documents with every awkward case, and plain-Python versions of what the operators compute."""
from __future__ import annotations

import collections
import hashlib
import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, shard int"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Random prose with nulls, empty and long texts, repeated rows and ids, near copies; extra columns with names that
    operators use too."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(120)]
    texts = [" ".join(rng.choice(vocabulary).title() if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 40, 80]))) for _ in range(n)]
    for i in range(0, n - 1, 7):
        words = texts[i].split()
        if len(words) > 30:
            words[3] = "changed"
            texts[i + 1] = " ".join(words)
    texts[4], texts[5], texts[6], texts[8] = None, "", " \n\t ", "!!! 123 ???"
    texts[9] = " ".join(rng.choice(vocabulary) for _ in range(20_000))
    rows = [(i, t, rng.choice(["en", "fr", None]), "src0" if rng.random() < 0.4 else f"src{i}", len(t or ""), 0.5, i, 1) for i, t in enumerate(texts)]
    return rows + [rows[12], rows[12], (None, texts[13], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


def shingles(text: str | None, size: int) -> frozenset:
    w = SPACED.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def components(rows: list[tuple], size: int, num: int, den: int) -> list[tuple]:
    """(id, set size, component) per row, by comparing all pairs that share a shingle."""
    sets = [shingles(r[1], size) for r in rows]
    above = list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    holders = collections.defaultdict(list)
    for k, s in enumerate(sets):
        shared = collections.Counter(o for e in s for o in holders[e])
        for o, same in shared.items():
            if same * den >= (len(s) + len(sets[o]) - same) * num:
                above[top(o)] = top(k)
        for e in s:
            holders[e].append(k)
    least: dict[int, int | None] = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[top(k)] = min(least.get(top(k), r[0]), r[0])
    return [(r[0], len(s), least.get(top(k)) if s else r[0]) for k, (r, s) in enumerate(zip(rows, sets))]


def contamination(text: str | None, items: list[tuple], window: int = 13) -> tuple:
    """(n_words, n_hit, n_items, digest, contaminated)."""
    w = ALNUM.findall((text or "").translate(LOWER))
    hit, ids = set(), set()
    for item, body in items:
        b = ALNUM.findall((body or "").translate(LOWER))
        size = min(window, len(b))
        wanted = {tuple(b[p : p + size]) for p in range(len(b) - size + 1)} if size else set()
        for p in range(len(w) - size + 1):
            if size and tuple(w[p : p + size]) in wanted:
                hit.update(range(p, p + size))
                ids.add("" if item is None else str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def ordered(rows) -> list:
    return sorted((tuple(r) for r in rows), key=repr)
