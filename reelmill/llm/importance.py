"""Resampling towards a target distribution by hashed runs of words.

Texts are sequences of words: A-Z lower-cased, split at every ASCII character that is no letter or digit. Features are all
runs of 1 to ``RUN`` words joined by one space; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``BUCKETS``.

1. A task forms an Aho-Corasick automaton of the distinct words of a portion of its texts, each between its delimiters. A
   word's payload is its CRC-32 and its length. The dictionary belongs to the portion, so its size is bounded and nothing
   is gathered or broadcast.
2. The automaton scans each text and emits payloads. CRCs are linear, so the CRC of a run follows from the payloads of
   adjacent words: that of the first, shifted by the length of the second, XOR that of the second.
3. Counts per bucket are summed in each task, then by Spark; ``BUCKETS`` gains come back and a second scan adds them up.
4. The highest scores (weight plus Gumbel noise from a hash of the id) are drawn by a global order in range partitions.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import cache
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import free_name, pick
from reelmill.operators.ordering import with_position
from reelmill.session import cut_lineage

BUCKETS = 10_000
RUN = 3
PORTION = 4 << 20  # bytes of texts that share a dictionary
LONG = 64  # longer words stand in the dictionary by a number, so its depth is bounded
SEED = 42

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_PLAIN = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD_BYTES else 0x20 for b in range(256))
_LONG = re.compile(rb"[^ ]{%d,}" % (LONG + 1))


@cache
def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of the linear map "n zero bytes follow", for each byte of a CRC: n = 0 to 63, and n = 64, 128, 256 ..."""
    low = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        low = np.where(low & 1, (low >> 1) ^ np.uint32(0xEDB88320), low >> 1)
    few = [np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]]
    for _ in range(64):
        few.append((few[-1] >> 8) ^ low[few[-1] & 255])
    powers = [few.pop()]
    while len(powers) < 26:
        powers.append(_mapped(powers[-1], powers[-1]))
    return np.stack(few), powers


def _mapped(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0, crc & 255] ^ table[1, crc >> 8 & 255] ^ table[2, crc >> 16 & 255] ^ table[3, crc >> 24]


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of two byte strings in a row from theirs and the length of the second."""
    few, powers = _shifts()
    n = length & 63
    out = few[n, 0, first & 255] ^ few[n, 1, first >> 8 & 255] ^ few[n, 2, first >> 16 & 255] ^ few[n, 3, first >> 24]
    more, k = length >> 6, 0
    while more.any():
        at = np.flatnonzero(more & 1)
        out[at] = _mapped(powers[k], out[at])
        more, k = more >> 1, k + 1
    return out ^ second


class Dictionary:
    """An automaton over delimiter-bounded words, and the payload of each: CRC-32 alone and with a space, and length."""

    def __init__(self, texts: list[bytes]):
        self.long: dict[bytes, bytes] = {}
        self.texts = [_LONG.sub(self._stand_in, t) for t in texts]
        words = sorted(set().union(*(t.split() for t in self.texts)))  # neighbours in the automaton lie together
        names = {short: word for word, short in self.long.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(words):
            self.automaton.add_word(f" {word.decode('latin-1')} ", i)
        self.automaton.make_automaton()
        full = [names.get(w, w) for w in words]
        self.crc = np.fromiter(map(zlib.crc32, full), np.uint32, len(full))
        self.spaced = np.fromiter((zlib.crc32(b" ", c) for c in self.crc.tolist()), np.uint32, len(full))
        self.length = np.fromiter(map(len, full), np.int64, len(full))

    def _stand_in(self, found: re.Match) -> bytes:
        return self.long.setdefault(found.group(), b"\x01%d" % len(self.long))

    def scan(self) -> tuple[np.ndarray, np.ndarray]:
        """The dictionary places of all words of the texts in order, and the number of words of each text."""
        if not len(self.crc):
            return np.empty(0, np.int64), np.zeros(len(self.texts), np.int64)
        parts = [
            np.fromiter(map(itemgetter(1), self.automaton.iter(f" {t.decode('latin-1')} ")), np.int64) for t in self.texts
        ]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For portions of the texts: the words of each text, and bucket and text (place in the portion) of all features."""
    for part in _portions(texts):
        known = Dictionary(part)
        at, n_words = known.scan()
        owner = np.repeat(np.arange(len(part)), n_words)
        crc, spaced, length = known.crc[at], known.spaced[at], known.length[at]
        run, buckets, owners = crc, [crc % BUCKETS], [owner]
        for k in range(1, min(RUN, len(at))):
            # the run of k words before, a space, and the next word
            before = spaced[:-1] if k == 1 else joined(before[:-1], spaced[k - 1 : -1], length[k - 1 : -1] + 1)
            run = joined(before, crc[k:], length[k:])
            inside = owner[k:] == owner[:-k]
            buckets.append(run[inside] % BUCKETS)
            owners.append(owner[k:][inside])
        yield n_words, np.concatenate(buckets), np.concatenate(owners)


def _portions(texts: list[str | None]) -> Iterator[list[bytes]]:
    part, n = [], 0
    for text in texts:
        part.append((text or "").encode("utf-8", "replace").translate(_PLAIN))
        n += len(part[-1])
        if n > PORTION:
            yield part
            part, n = [], 0
    if part:
        yield part


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, buckets, _ in features(batch.column("text").to_pylist()):
            total += np.bincount(buckets, minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])


def bucket_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``bucket, n``: features per bucket over all texts; buckets without any are left out. No texts give no rows."""
    counted = df.select(F.col(text_col).alias("text")).mapInArrow(_counted, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, text_col: str = "text") -> np.ndarray:
    """Per bucket floor(1000 ln) of its smoothed share in the target over that in the corpus.

    ``BUCKETS`` numbers reach the driver whatever the size of the tables.
    """
    s, t = (_dense(bucket_counts(df, text_col)) for df in (corpus, target))
    all_s, all_t = float(sum(s)), float(sum(t))
    return np.array([
        math.floor(1000 * math.log((b + 1.0) * (all_s + BUCKETS) / ((a + 1.0) * (all_t + BUCKETS)))) for a, b in zip(s, t)
    ], np.int64)


def _dense(counts: DataFrame) -> list[int]:
    out = [0] * BUCKETS
    for row in counts.toLocalIterator():
        out[row.bucket] = row.n
    return out


def _weighed(gain: np.ndarray):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, found, weights = [], [], []
            for n_words, buckets, owners in features(batch.column("text").to_pylist()):
                words.append(n_words)
                found.append(np.bincount(owners, minlength=len(n_words)))
                weights.append(np.bincount(owners, gain[buckets], len(n_words)).astype(np.int64))  # whole numbers below 2^53
            sums = [np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64) for c in (words, found, weights)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "text_hash")), *map(pa.array, sums)],
                ["doc_id", "text_hash", "n_words", "n_features", "weight"])

    return of


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of the id; null for a null id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def weights(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``doc_id, text_hash, n_words, n_features, weight, score`` of every row; null texts have no words and weight 0."""
    docs = pick(df, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    kind = dict(docs.dtypes)["doc_id"]
    told = docs.mapInArrow(_weighed(gain), f"doc_id {kind}, text_hash long, n_words long, n_features long, weight long")
    return told.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(df: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, id_col: str = "doc_id",
           text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``weights`` of every row and its ``rank`` among the floor(percent * N / 100) that are drawn, else null.

    N counts the rows of at least ``min_words`` words. Highest scores come first, ties in order of the ids, then of a hash of
    the text; repeated rows hold a rank each. A row with a null id has no score and is neither counted nor drawn. Without
    target texts all gains follow from the corpus alone; an empty table gives no rows.
    """
    told = cut_lineage(weights(df, gains(df, target, text_col), id_col, text_col, seed))
    able = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    drawn = told.filter(able).count() * percent // 100
    order = [able.desc(), F.col("score").desc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("text_hash").asc()]
    placed = with_position(told, order, "rank")
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))


def resample(df: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, id_col: str = "doc_id",
             text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The rows of ``df`` that are drawn, all columns. A repeated row stays whole if one of its copies is drawn."""
    found = ranked(df, target, percent, min_words, id_col, text_col, seed).filter("rank IS NOT NULL")
    keys = found.select(F.col("doc_id").alias("id"), "text_hash").distinct()
    name = free_name(df)
    told = df.withColumn(name, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")))
    return told.join(keys.select(F.struct("id", "text_hash").alias(name)), name, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
