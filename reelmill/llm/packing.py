"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

Full pieces are sequences by themselves. The others are dealt to blocks of about ``BLOCK`` pieces. For each block, islands
breed packings whose genes are whole sequences: a child takes well-filled sequences of one parent, loses those of the other that
repeat a piece, and displaced pieces go where they fit best. After each epoch an island's best packing moves to the
next island. An island stops early when no packing can be smaller.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import pick, release
from reelmill.llm.tokens import CACHE, encoder
from reelmill.session import cut_lineage

CAPACITY = 2048
END = 0
BLOCK = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 12

Packing = list[list[int]]  # per sequence the pieces in it


def _cut(path: str, style: str, capacity: int, cache: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        ids_of = encoder(path, style, cache)
        for batch in batches:
            rows: list[tuple] = []
            for at, found in enumerate(ids_of(batch.column("text").to_pylist())):
                ids = np.append(found, np.uint32(END)).astype("<u4")
                rows += [(at, n, start, min(capacity, len(ids) - start), zlib.crc32(ids[start : start + capacity].tobytes()))
                         for n, start in enumerate(range(0, len(ids), capacity))]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()),
                 *[pa.array(c, pa.int64()) for c in columns[2:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return of


def pieces(df: DataFrame, tokenizer: str, style: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
           cache: int = CACHE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``; a null text is empty and has its end id alone.

    ``cache`` bounds the word pieces a worker remembers, not the result.
    """
    docs = pick(df, id_col, text_col)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(_cut(tokenizer, style, capacity, cache), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(bins: Packing, room: list[int], items: list[int], sizes: list[int], capacity: int) -> Packing:
    """Puts the items, one by one, into the sequence with the least sufficient room, or a new one."""
    free = sorted((r, b) for b, r in enumerate(room))
    for i in items:
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            left, b = free.pop(at)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        insort(free, (left - sizes[i], b))
    return bins


def fitness(bins: Packing, sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer sequences, then fuller ones; higher is better."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(len(bins), 1)


def crossover(first: Packing, second: Packing, sizes: list[int], capacity: int, draw: random.Random) -> Packing:
    """The second parent with well-filled sequences of the first."""
    full = sorted(first, key=lambda b: (-sum(sizes[i] for i in b), draw.random()))
    full = full[: max(1, len(full) // 2)]
    injected = draw.sample(full, max(1, len(full) // 2))
    taken = {i for b in injected for i in b}
    kept = [b for b in second if taken.isdisjoint(b)]
    displaced = [i for b in second if not taken.isdisjoint(b) for i in b if i not in taken]
    child = [list(b) for b in injected + kept]
    return best_fit(child, [capacity - sum(sizes[i] for i in b) for b in child], sorted(displaced, key=lambda i: -sizes[i]), sizes, capacity)


def evolve(sizes: list[int], capacity: int, start: list[Packing], seed: int) -> Packing:
    """Best packing of one island after an epoch."""
    if not sizes:
        return []
    draw, fewest = random.Random(seed), -(-sum(sizes) // capacity)
    people = list(start)
    orders = [sorted(range(len(sizes)), key=lambda i: -sizes[i])]
    while len(people) < POPULATION:
        order = orders.pop() if orders else sorted(range(len(sizes)), key=lambda i: -sizes[i] * draw.uniform(0.7, 1))
        people.append(best_fit([], [], order, sizes, capacity))
        if len(people[-1]) == fewest:
            return people[-1]
    worth = lambda p: fitness(p, sizes, capacity)
    people = sorted(people, key=worth, reverse=True)
    for _ in range(GENERATIONS):
        if len(people[0]) == fewest:
            break
        a, b = draw.sample(people, 2)
        people = sorted([*people, crossover(a, b, sizes, capacity, draw)], key=worth, reverse=True)[:POPULATION]
    return people[0]


def _island(capacity: int):
    def of(group: pd.DataFrame) -> pd.DataFrame:
        """Rows of a block's pieces, once for each packing (``origin``) that came to the island; ``bin`` < 0: no packing yet."""
        group = group.sort_values(["origin", "doc_id", "piece", "start", "length", "ids_crc32", "twin"], kind="stable")
        origins = group["origin"].unique()
        own = group[group["origin"] == origins[0]].reset_index(drop=True)
        sizes = own["length"].tolist()
        start = []
        for o in origins:
            bins = group.loc[group["origin"] == o, "bin"].to_numpy()
            if bins[0] >= 0:
                packed: dict[int, list[int]] = {}
                for i, b in enumerate(bins):
                    packed.setdefault(int(b), []).append(i)
                start.append(list(packed.values()))
        seed = int(own["block"].iloc[0]) * 31 + int(own["island"].iloc[0]) + 7919 * len(start)
        found = evolve(sizes, capacity, start, seed)
        bins = np.empty(len(sizes), np.int64)
        offsets = np.empty(len(sizes), np.int64)
        for b, members in enumerate(found):
            at = 0
            for i in members:
                bins[i], offsets[i], at = b, at, at + sizes[i]
        return own.assign(bin=bins, offset=offsets, origin=own["island"], n_bins=len(found), fill=fitness(found, sizes, capacity)[1])

    return of


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; every length is 1 to ``capacity``.

    Rows that are alike are packed as pieces of their own. Empty input gives no rows.
    """
    parts = cut_lineage(parts.withColumn("twin", F.monotonically_increasing_id()))
    whole = parts.filter(F.col("length") >= capacity).select(
        "*", (-1 - F.col("twin")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = parts.filter(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // BLOCK))
    block = F.pmod(F.xxhash64("doc_id", "piece", "twin"), F.lit(blocks)).cast("long")
    state = rest.withColumn("block", block).withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    state = state.withColumns({"origin": F.col("island"), "bin": F.lit(-1).cast("long"), "offset": F.lit(0).cast("long"),
                               "n_bins": F.lit(0), "fill": F.lit(0.0)})
    for epoch in range(EPOCHS):
        if epoch:
            moved = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))  # elites go on to the next island
            state = state.unionByName(moved)
        state = cut_lineage(state.groupBy("block", "island").applyInPandas(_island(capacity), state.schema))
    best = state.groupBy("block").agg(F.min(F.struct("n_bins", -F.col("fill"), "island")).alias("b"))
    best = cut_lineage(best.select("block", F.col("b.island").alias("island")))
    packed = state.join(F.broadcast(best), ["block", "island"])  # one row per BLOCK pieces
    placed = packed.withColumn("sequence_id", F.shiftleft("block", 24).bitwiseOR(F.col("bin")))
    return whole.unionByName(placed.select(whole.columns)).drop("twin")
