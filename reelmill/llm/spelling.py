"""Groups of spelling variants: words of a corpus that differ by one inserted, deleted or replaced character.

1. Runs of letters are counted over all texts; words of a minimum length and frequency are the vocabulary.
2. A word is a vector of letter counts. A near word has a squared distance of 1 (one letter more or less) or 2 (one letter
   for another). Letters fall into ``GROUPS`` groups; words with the same sums per group form a block, so a near word is in
   the same block or in one where one sum is higher by one, or one is higher and another lower. Every word is sent to
   these blocks (half of them; a pair meets once), in which NumPy products give all squared distances at once.
3. Pairs at distance 1 in adjacent lengths, or 2 in the same length, are verified character by character. A task adds
   up each word's near words and keeps the most frequent; pairs are not emitted.
4. Blocks are cut into parts of about ``PART`` characters, so a common signature never meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import lower_ascii
from reelmill.operators.ordering import spread
from reelmill.session import cut_lineage

GAPS = "[^a-z\\u00C0-\\u00FF]+"
MODULUS = 199
GROUPS = 6
PART = 1 << 16
LETTERS = 26 + 64  # a to z, and the 64 code points from U+00C0
GRAM = 4_000_000  # products at once

_STEP = np.random.default_rng(7).integers(1, 2**62, GROUPS, dtype=np.int64) | 1  # a block's key is the sum of steps; it may wrap


def vocabulary(df: DataFrame, min_length: int = 6, min_count: int = 5, id_col: str = "doc_id", text_col: str = "text",
               modulus: int = MODULUS) -> DataFrame:
    """``word, n``: distinct words of at least ``min_length`` characters and ``min_count`` occurrences.

    Runs of letters are lower-cased (A-Z only). Where ``modulus`` divides the CRC-32 h of ``<id>:<run>`` the run loses its
    character at h % length. Null texts have no words; a null id counts as empty text.
    """
    runs = df.select(F.col(id_col).cast("string").alias("id"),
                     F.explode(F.split(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), GAPS)).alias("run"))
    runs = runs.filter(F.length("run") >= min_length)
    h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run").cast("binary"))
    told = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = told.select(F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def letter_counts(codes: list[bytes]) -> np.ndarray:
    """Words (Latin-1) by letters: how often each occurs."""
    flat = np.frombuffer(b"".join(codes), np.uint8).astype(np.int64)
    column = np.where(flat < 128, flat - 97, flat - 0xC0 + 26)
    row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    return np.bincount(row * LETTERS + column, minlength=len(codes) * LETTERS).reshape(len(codes), LETTERS)


def _coded(words: pd.Series) -> list[bytes]:
    return [w.encode("latin-1") for w in words]


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The block of every word."""
    for batch in batches:
        if len(batch):
            yield batch.assign(key=_sums(batch["word"]) @ _STEP)


def _sums(words: pd.Series) -> np.ndarray:
    counts = letter_counts(_coded(words))
    return np.stack([counts[:, g::GROUPS].sum(axis=1) for g in range(GROUPS)], axis=1)


def _asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every word with the other blocks it is compared in: one sum higher, or one lower and a later one higher."""
    for batch in batches:
        if not len(batch):
            continue
        sums, keys = _sums(batch["word"]), batch["key"].to_numpy()
        for j in range(GROUPS):
            yield batch.assign(key=keys + _STEP[j])
            for i in range(j):
                some = sums[:, i] > 0
                yield batch[some].assign(key=keys[some] - _STEP[i] + _STEP[j])


class _Words:
    """Words of one group of rows: letter counts, and their characters aligned at the left and at the right."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = words, n
        coded = [w.encode("latin-1") for w in words]
        self.length = np.array([len(c) for c in coded])
        counts = letter_counts(coded)
        self.vectors = counts.astype(np.float32 if counts.max(initial=0) < 1000 else np.float64)  # products stay exact
        self.square = (self.vectors * self.vectors).sum(axis=1)
        self.coded = coded

    def left(self, at: np.ndarray, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.coded[i].ljust(width, b"\0") for i in at), np.uint8).reshape(len(at), width)

    def right(self, at: np.ndarray, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.coded[i].rjust(width, b"\0") for i in at), np.uint8).reshape(len(at), width)


def near_pairs(a: _Words, b: _Words, same: bool = False) -> Iterator[tuple[int, int]]:
    """Places of near words in two lists, each pair once (``same``: the lists are one)."""
    step = max(1, GRAM // max(1, len(b.words)))
    for first in range(0, len(a.words), step):
        rows = slice(first, first + step)
        distance = a.square[rows, None] + b.square[None, :] - 2 * (a.vectors[rows] @ b.vectors.T)
        i, j = np.nonzero((distance == 1) | (distance == 2))
        i += first
        if same:
            i, j = i[i < j], j[i < j]
        apart = np.abs(a.length[i] - b.length[j])
        likely = ((distance[i - first, j] == 1) & (apart == 1)) | ((distance[i - first, j] == 2) & (apart == 0))
        i, j = i[likely], j[likely]
        width = int(max(a.length[i].max(initial=0), b.length[j].max(initial=0)))
        for part in np.array_split(np.arange(len(i)), max(1, len(i) * width // GRAM)):
            yield from _verified(a, b, i[part], j[part], width)


def _verified(a: _Words, b: _Words, i: np.ndarray, j: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """The pairs whose common beginning and end leave at most one character of the longer word."""
    if not len(i):
        return
    longer = np.maximum(a.length[i], b.length[j])
    begin = np.logical_and.accumulate(a.left(i, width) == b.left(j, width), axis=1).sum(axis=1)
    end = np.logical_and.accumulate((a.right(i, width) == b.right(j, width))[:, ::-1], axis=1).sum(axis=1)
    good = begin + end >= longer - 1
    yield from zip(i[good].tolist(), j[good].tolist())


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``word, n_near, best_n, best`` of the pairs in each group (key, part) of rows; its own words come before those that ask."""
    at, own, waiting, found = None, [], [], {}
    columns = ["word", "n_near", "best_n", "best"]

    def note(word: str, other: str, n: int) -> None:
        seen = found.get(word)
        if seen is None:
            found[word] = [1, -n, other]
        else:
            seen[0] += 1
            seen[1:] = min(seen[1:], [-n, other])

    def meet(a: _Words, b: _Words, same: bool = False) -> None:
        for i, j in near_pairs(a, b, same):
            note(a.words[i], b.words[j], b.n[j])
            note(b.words[j], a.words[i], a.n[i])

    for batch in batches:
        for group, rows in batch.groupby(["key", "part"], sort=False):
            if group != at:
                if at is not None and own:
                    meet(own[0], own[0], True)
                if len(found) > 50_000:
                    yield pd.DataFrame([(w, c, -m, o) for w, (c, m, o) in found.items()], columns=columns)
                    found.clear()
                at, own, waiting = group, [], []
            mine = rows[~rows["asks"]]
            if len(mine):  # a part is bounded, so its words may be put together again
                waiting = waiting + list(zip(mine["word"], mine["n"].tolist()))
                own = [_Words([w for w, _ in waiting], [n for _, n in waiting])]
            asks = rows[rows["asks"]]
            if len(asks) and own:
                meet(_Words(asks["word"].tolist(), asks["n"].tolist()), own[0])
    if own:
        meet(own[0], own[0], True)
    yield pd.DataFrame([(w, c, -m, o) for w, (c, m, o) in found.items()], columns=columns)


def near_words(known: DataFrame, part: int = PART) -> DataFrame:
    """``word, n_near, best_n, best``: how many near words each of ``word, n`` has, and the most frequent, ties to the smallest.

    Words without any are left out.
    """
    keyed = cut_lineage(known.mapInPandas(_keyed, "word string, n long, key long"))
    blocks = keyed.groupBy("key").agg(F.ceil(F.sum(F.length("word")) / part).cast("int").alias("parts"))
    own_part = F.pmod(F.xxhash64("word"), "parts").cast("int")
    inside = keyed.join(blocks, "key").withColumn("part", own_part)
    mine = inside.select("key", "part", F.lit(False).alias("asks"), "word", "n")
    # the same block: words of a part ask in the later ones
    later = inside.filter("part < parts - 1").select(
        "key", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "word", "n")
    others = keyed.mapInPandas(_asking, "word string, n long, key long").join(blocks, "key").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "word", "n")
    dealt = spread(mine.unionByName(later).unionByName(others), "key", "part").sortWithinPartitions("key", "part", "asks")
    met = dealt.mapInPandas(_met, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame, depth: int) -> DataFrame:
    """``word, root``: the end of each word's path over ``word, form``, by doubling; paths have at most ``depth`` steps."""
    paths = cut_lineage(forms.select("word", F.col("form").alias("root")))
    for _ in range(max(0, math.ceil(math.log2(max(1, depth))))):
        onward = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        paths = cut_lineage(paths.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return paths


def variants(df: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, id_col: str = "doc_id",
             text_col: str = "text", modulus: int = MODULUS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary.

    ``form``: the most frequent near word (ties: the smallest in code-point order) if it is at least ``ratio`` times as
    frequent, else null; ``root``: the last word when forms are followed, the word itself without one. Repeated rows
    count again. An empty table gives no rows.
    """
    known = cut_lineage(vocabulary(df, min_length, min_count, id_col, text_col, modulus))
    near = near_words(known)
    told = cut_lineage(known.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_n")).alias("form_n")))
    most = known.agg(F.max("n")).first()[0] or 1
    roots = _roots(told.filter("form IS NOT NULL"), 1 + int(math.log(most) / math.log(ratio)))  # every step is ``ratio`` times as frequent
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
