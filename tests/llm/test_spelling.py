"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reelmill.llm import spelling
from tests.conftest import SF
from tests.llm.conftest import ODD

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_words(docs):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(known):
    by = {}
    for w in known:
        for cut in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(cut, set()).add(w)
    met = {w: set() for w in known}
    for group in by.values():
        for a in group:
            met[a].update(b for b in group if near(a, b))
    form = {}
    for w, n in known.items():
        best = min(met[w], key=lambda o: (-known[o], o), default=None)
        form[w] = best if best is not None and known[best] >= 5 * n else None
    out = []
    for w, n in known.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(met[w]), known.get(form[w])))
    return sorted(out)


def got(df, **how):
    return sorted(map(tuple, spelling.variants(df, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(docs) == plain_variants(plain_words([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))


def test_odd_input(spark, odd_rows):
    assert got(odd_rows) == plain_variants(plain_words([r[:2] for r in ODD])) == []
    rare = {r[0]: r[3] for r in got(odd_rows, min_length=1, min_count=1)}
    assert rare["lorem"] == 8000 and rare["seven"] == 3
    assert got(odd_rows.limit(0)) == []


@pytest.mark.parametrize("part", [40, 1 << 16])
def test_near_words_in_parts(spark, part):
    """Many words of few letters: common signatures, which small parts split, and long words."""
    rng = random.Random(5)
    words = {"".join(rng.choices("abcgàÿ", k=rng.choice([6, 7, 7, 8]))) for _ in range(1500)}
    words |= {"a" * k for k in range(6, 40)} | {"ab" * 700, "ab" * 700 + "c", "ab" * 300 + "b" + "ab" * 400, "ba" * 700}
    known = {w: rng.choice([5, 9, 50, 3000]) for w in words}
    found = spelling.near_words(spark.createDataFrame(list(known.items()), "word string, n long"), part).collect()
    want = {w: (c, m, o) for w, c, m, o in plain_near(known)}
    assert {r.word: (r.n_near, r.best_n, r.best) for r in found} == want


def plain_near(known):
    for w in known:
        others = [o for o in known if near(w, o)]
        if others:
            best = min(others, key=lambda o: (-known[o], o))
            yield w, len(others), known[best], best


def test_roots_follow_long_paths(spark):
    """A chain of forms, each five times as frequent as the one before."""
    chain = ["abcdefgh"[:i] + "zzzzzzzz"[i:] for i in range(9)]
    text = [(i, " ".join([w] * 5 ** (k + 1))) for i, (k, w) in enumerate(enumerate(chain[:6]))]
    rows = got(spark.createDataFrame(text, "doc_id long, text string"), modulus=2**33)
    assert {r[2] for r in rows} == {chain[5]} and len(rows) == 6


def test_pairs_of_vectors():
    a = spelling._Words(["abcdef", "abcxef"], [1, 1])
    assert list(spelling.near_pairs(a, a, True)) == [(0, 1)]
    counts = spelling.letter_counts(["aabÿ".encode("latin-1")])
    assert counts.sum() == 4 and np.flatnonzero(counts[0]).tolist() == [0, 1, spelling.LETTERS - 1]
