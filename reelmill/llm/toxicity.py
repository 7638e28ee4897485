"""Toxicity by the nearest labelled examples.

Features of a text are its words and their beginnings of 4 and 5 letters. Those that labelled toxic texts use far more
often than clean ones (likelihood ratio, against what chance would bring among all features tested) make the vocabulary; near copies of
one example count once there. Texts become TF-IDF vectors of unit length over it; document frequencies are
counted over all documents. The ``NEIGHBOURS`` examples of highest cosine are found exactly with an inverted index in blocks:
a block whose best possible cosine does not beat the worst neighbour found so far is not opened. Their labels vote, closer
ones more; votes are calibrated on the examples, each left out in turn. A text without any feature of the vocabulary
has no neighbours and gets the rate of such texts among the examples.

Learning is bounded by at most ``EXAMPLES`` labelled rows (drawn by a hash of the id); all features that pass are kept.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import give_back, pick, short_batches
from reelmill.session import broadcast_if_small, cut_lineage

EXAMPLES = 20_000
NEIGHBOURS = 15
BLOCK = 64
LIFT = 6.0  # a feature is this many times likelier in toxic than in clean examples
SUPPORT = 3
BANDS, ROWS = 16, 6  # MinHash bands of 3-word runs: near copies of similarity 0.8 share one in 99 % of cases, of 0.3 in 1 %

_WORD = re.compile(r"\w+")


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def features(text: str | None) -> Counter:
    """Counts of words (``=word``) and of beginnings (``wor^``)."""
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        out["=" + word] += n
        for size in (4, 5):
            if len(word) >= size:
                out[word[:size] + "^"] += n
    return out


def _present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            names = list(features(text))
            if names:
                yield pd.DataFrame({"feature": names, "toxic": int(toxic)})


_FACTORS = np.random.default_rng(6).integers(1, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    give_back()
    for batch in batches:
        out = []
        for text, toxic in zip(batch["text"], batch["toxic"]):
            words = _WORD.findall((text or "").lower())
            code = {w: zlib.crc32(w.encode("utf-8", "replace")) for w in set(words)}
            h = np.array([code[w] for w in words] + [1] * max(0, 3 - len(words)), np.uint64)
            runs = np.unique((h[:-2] * _FACTORS[0, 1] + h[1:-1]) * _FACTORS[1, 1] + h[2:])
            low = np.array([(((runs ^ (runs >> np.uint64(29))) * f + g) >> np.uint64(24)).min() for f, g in _FACTORS])
            out.append([zlib.crc32(part.tobytes()) << 8 | at << 1 | int(toxic) for at, part in enumerate(low.reshape(BANDS, ROWS))])
        yield pd.DataFrame({"key": batch["key"], "row": batch["row"], "band": out})


def distinct(examples: DataFrame) -> DataFrame:
    """The examples without those that nearly copy another one of the same label; which one stays does not depend on row order."""
    keyed = cut_lineage(examples.select("text", "toxic", F.xxhash64("text", "toxic").alias("key"), F.monotonically_increasing_id().alias("row")))
    told = cut_lineage(keyed.mapInPandas(_bands, "key long, row long, band array<long>"))
    told = told.select(F.struct("key", "row").alias("at"), F.explode("band").alias("band"))
    first = told.groupBy("band").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = told.join(broadcast_if_small(first), "band").filter(F.col("at") > F.col("first")).select("at.row").distinct()
    return keyed.join(broadcast_if_small(later), "row", "left_anti")


def vocabulary(examples: DataFrame) -> list[str]:
    """Features of toxic examples, by strength of association; ``examples(text, toxic)`` is bounded, the list too."""
    examples = cut_lineage(distinct(examples))
    totals = examples.agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).first()
    if not totals["toxic"] or not totals["clean"]:
        return []
    seen = examples.select("text", "toxic").mapInPandas(_present, "feature string, toxic int")
    seen = seen.groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).filter(F.col("a") >= SUPPORT)
    rate_a, rate_b = (F.col("a") + 0.5) / (totals["toxic"] + 1), (F.col("b") + 0.5) / (totals["clean"] + 1)
    seen = cut_lineage(seen)
    share = totals["toxic"] / (totals["toxic"] + totals["clean"])
    gain = lambda c, part: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("a") + F.col("b")) * part))).otherwise(0.0)
    seen = seen.withColumn("strength", 2 * (gain("a", share) + gain("b", 1 - share)))
    by_chance = 2 * math.log(2 * max(seen.count(), 1))  # about half a feature of all those tested is as strong by chance
    seen = seen.filter((rate_a >= LIFT * rate_b) & (F.col("strength") >= by_chance))
    return [r["feature"] for r in seen.orderBy(F.desc("strength"), "feature").toLocalIterator()]


def _vectors(names: list[str]):
    place = {name: i for i, name in enumerate(names)}

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            terms, counts = [], []
            for text in batch["text"]:
                found: Counter = Counter()
                for word, n in Counter(_WORD.findall((text or "").lower())).items():
                    for name in ("=" + word, word[:4] + "^", word[:5] + "^" if len(word) >= 5 else ""):
                        if name in place:
                            found[place[name]] += n
                order = sorted(found)
                terms.append(order)
                counts.append([found[t] for t in order])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "terms": terms, "counts": counts})

    return of


@dataclass
class Index:
    """Postings by term, in blocks of ``BLOCK`` examples, with the largest weight of a term in each block."""

    ids: np.ndarray
    labels: np.ndarray
    postings: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # examples, weights, first posting of each block
    highest: dict[int, np.ndarray]
    blocks: int

    @classmethod
    def build(cls, ids: list, labels: list[int], vectors: list[dict[int, float]]) -> "Index":
        order = sorted(range(len(ids)), key=lambda i: (max(vectors[i], key=vectors[i].get), sorted(vectors[i].items()), ids[i]))
        blocks = -(-len(ids) // BLOCK)
        raw: dict[int, list[tuple[int, float]]] = {}
        for at, i in enumerate(order):
            for t, w in vectors[i].items():
                raw.setdefault(t, []).append((at, w))
        postings, highest = {}, {}
        for t, pairs in raw.items():
            who, w = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
            postings[t] = (who, w, np.searchsorted(who, np.arange(blocks + 1) * BLOCK))
            highest[t] = np.zeros(blocks)
            np.maximum.at(highest[t], who // BLOCK, w)
        return cls(np.array([ids[i] for i in order]), np.array([labels[i] for i in order], float), postings, highest, blocks)

    def search(self, query: dict[int, float], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` nearest examples with a cosine over 0; ties go to the lower place."""
        known = [(t, q) for t, q in sorted(query.items()) if t in self.postings]
        none = np.empty(0, int), np.empty(0)
        if not known:
            return none
        bound = sum(q * self.highest[t] for t, q in known)
        places, cosines, worst = *none, 0.0
        for block in np.argsort(-bound, kind="stable"):
            if bound[block] <= 0 or len(places) >= k and bound[block] < worst - 1e-12:
                break
            score = np.zeros(BLOCK)
            for t, q in known:
                who, w, first = self.postings[t]
                part = slice(first[block], first[block + 1])
                score[who[part] - block * BLOCK] += q * w[part]
            if 0 <= without - block * BLOCK < BLOCK:
                score[without - block * BLOCK] = 0
            hit = np.flatnonzero(score > 0)
            places, cosines = np.concatenate([places, hit + block * BLOCK]), np.concatenate([cosines, score[hit]])
            best = np.lexsort((places, -np.round(cosines, 12)))[:k]
            places, cosines = places[best], cosines[best]
            worst = cosines[-1] if len(cosines) >= k else 0.0
        return places, cosines


@dataclass
class Model:
    names: list[str]
    idf: np.ndarray
    index: Index
    base: float  # toxic share of the examples that have a vector
    bare: float  # and of those that have none
    slope: float = 1.0
    shift: float = 0.0

    def unit(self, terms, counts) -> dict[int, float]:
        weights = {int(t): (1 + math.log(n)) * self.idf[int(t)] for t, n in zip(terms, counts)}
        length = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / length for t, w in weights.items()}

    def vote(self, query: dict[int, float], without: int = -1) -> tuple[float, np.ndarray]:
        places, cosines = self.index.search(query, NEIGHBOURS, without)
        weight = 1 / (1.05 - cosines)
        return float((weight @ self.index.labels[places] + self.base) / (weight.sum() + 1)), places

    def score(self, terms, counts) -> tuple[float, list]:
        if not len(terms):
            return self.bare, []
        raw, places = self.vote(self.unit(terms, counts))
        return _squash(self.slope * _logit(raw) + self.shift), self.index.ids[places].tolist()


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _squash(x) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _calibrated(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the votes, held near (1, 0) where examples are few."""
    x, (a, b) = _logit(votes), (1.0, 0.0)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - labels) * x).sum() + 5 * (a - 1), (p - labels).sum() + 5 * b])
        v = p * (1 - p)
        h = np.array([[(v * x * x).sum() + 5, (v * x).sum()], [(v * x).sum(), v.sum() + 5]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 0.1)), float(b)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Model, DataFrame]:
    """The model and the sparse vectors ``doc_id, terms, counts`` of all rows.

    Labels count for ids whose crc32 is not divisible by 5; an id labelled twice is toxic if one label says so, null labels
    and ids are left out. Without labels of both kinds there is no vocabulary and all rows get the smoothed rate.
    """
    short_batches(df.sparkSession)
    docs = pick(df, id_col, text_col)
    told = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    told = told.filter(in_training(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = cut_lineage(told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES))
    names = vocabulary(docs.join(F.broadcast(drawn), "doc_id"))  # at most EXAMPLES ids
    vectors = cut_lineage(docs.mapInPandas(_vectors(names), f"doc_id {dict(docs.dtypes)['doc_id']}, terms array<int>, counts array<int>"))
    total = vectors.count()
    counted = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    df_of = {r["t"]: r["n"] for r in counted.toLocalIterator()}  # one row per feature of the vocabulary
    idf = np.array([math.log((1 + total) / (1 + df_of.get(i, 0))) + 1 for i in range(len(names))])
    rows = vectors.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"])
    bare = rows.filter(F.size("terms") == 0).agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    rest = list(rows.filter(F.size("terms") > 0).orderBy("doc_id").toLocalIterator())  # at most EXAMPLES short vectors
    ones = sum(r["toxic"] for r in rest)
    model = Model(names, idf, Index.build([], [], []), (ones + 1) / (len(rest) + 2), ((bare["t"] or 0) + 0.1) / (bare["n"] + 1))
    units = [model.unit(r["terms"], r["counts"]) for r in rest]
    model.index = Index.build([r["doc_id"] for r in rest], [r["toxic"] for r in rest], units)
    if rest:
        at = {d: i for i, d in enumerate(model.index.ids.tolist())}
        votes = np.array([model.vote(u, at[r["doc_id"]])[0] for r, u in zip(rest, units)])
        model.slope, model.shift = _calibrated(votes, np.array([r["toxic"] for r in rest], float))
    return model, vectors


def scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` (ids of the nearest examples, nearest first) for every row.

    Null and empty texts and null ids are scored like others, repeated rows each.
    """
    model, vectors = fit(df, labels, id_col, text_col, label_col)
    kind = dict(vectors.dtypes)["doc_id"]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.score(t, c) for t, c in zip(batch["terms"], batch["counts"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [f[0] for f in found], "evidence": [f[1] for f in found]})

    judged = vectors.mapInPandas(judge, f"doc_id {kind}, score double, evidence array<{kind}>")
    return judged.select("doc_id", (~in_training(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows with a score below 0.5, all columns; rows never leave their task."""
    model, _ = fit(df, labels, id_col, text_col, label_col)
    extract = _vectors(model.names)
    slim = df.select(F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row"))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pd.DataFrame({"doc_id": 0, "text": batch.column("text").to_pylist()})
            clean = [model.score(t, c)[0] < 0.5 for v in extract([texts]) for t, c in zip(v["terms"], v["counts"])]
            yield batch.filter(pa.array(clean, pa.bool_()))

    kept = slim.mapInArrow(passed, slim.schema)
    return kept.select([F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)])
