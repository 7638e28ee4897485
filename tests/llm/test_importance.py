"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from reelmill.llm import importance
from tests.conftest import SF
from tests.llm.conftest import ODD

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_features(text):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain_draw(docs, target):
    s, t = ([b for x in side for b in plain_features(x)[1]] for side in ([x for _, x in docs], target))
    ns, nt = np.bincount(s, minlength=10000), np.bincount(t, minlength=10000)
    gain = [math.floor(1000 * math.log((float(b) + 1) * (len(s) + 10000) / ((float(a) + 1) * (len(t) + 10000)))) for a, b in zip(ns, nt)]
    rows = []
    for doc_id, text in docs:
        n_words, buckets = plain_features(text)
        weight, score = sum(gain[b] for b in buckets), None
        if doc_id is not None:
            h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, n_words, len(buckets), weight, score])
    able = sorted(((-r[4], r[0]) for r in rows if r[1] >= 20 and r[4] is not None))
    rank = {d: i + 1 for i, (_, d) in enumerate(able[: 5 * len(able) // 100])}
    return sorted((str(d), f, w, s, rank.get(d)) for d, _, f, w, s in rows)


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = importance.ranked(docs, target).collect()
    want = plain_draw([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score, r["rank"]) for r in got) == want
    drawn = importance.resample(docs, target)
    assert drawn.columns == docs.columns and drawn.count() == sum(r["rank"] is not None for r in got) > 0


def test_odd_input(spark, odd_rows):
    target = spark.createDataFrame([(1, "seven six five"), (2, None)], "item_id long, text string")
    got = importance.ranked(odd_rows, target).collect()
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score) for r in got) == [w[:4] for w in plain_draw([r[:2] for r in ODD], ["seven six five", None])]
    every = importance.ranked(odd_rows, target, percent=100, min_words=0).collect()
    assert sorted(r["rank"] or 0 for r in every) == list(range(len(ODD)))  # all but the null id
    drawn = importance.resample(odd_rows, target, percent=100, min_words=0)
    assert drawn.columns == odd_rows.columns and drawn.count() == len(ODD) - 1
    assert importance.ranked(odd_rows.limit(0), target).collect() == []
    assert all(r["rank"] is None for r in importance.ranked(odd_rows, target.limit(0)).collect())  # floor(5 * 1 / 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abÀ𝄞 -09Z\x00", max_size=200), max_size=6))
def test_features_of_any_texts(texts):
    texts = [*texts, "x" * 300 + " y " + "x" * 300 + "é" * 5000, None]
    found = [[] for _ in texts]
    counts = []
    for n_words, buckets, owners in importance.features(texts):
        counts += n_words.tolist()
        for b, o in zip(buckets.tolist(), owners.tolist()):
            found[o].append(b)
    assert [(n, sorted(f)) for n, f in zip(counts, found)] == [(n, sorted(b)) for n, b in map(plain_features, texts)]


def test_portions_change_nothing(monkeypatch):
    texts = ["some words here", "more words there", "words again", ""] * 3
    whole = sorted(b for _, buckets, _ in importance.features(texts) for b in buckets.tolist())
    monkeypatch.setattr(importance, "PORTION", 10)
    assert sorted(b for _, buckets, _ in importance.features(texts) for b in buckets.tolist()) == whole


@given(st.lists(st.tuples(st.binary(max_size=50), st.binary(max_size=9000)), min_size=1, max_size=5))
def test_joined_crc(pairs):
    first, second = (np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1))
    got = importance.joined(first, second, np.array([len(p[1]) for p in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]
