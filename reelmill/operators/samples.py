"""Sample construction: tail filter, negatives, resampling, splits and vocabularies."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.hashing import code, draw
from reelmill.operators.ordering import hash_cut, spread, with_position, with_running_sum
from reelmill.session import broadcast_if_small, cut_lineage, stored

# Seeds of the sample builders.
DATASET_SEED = 20260402
SPLIT_SEED = 20260404
VECTOR_SEED = 20260105

DRAWS_PER_CHUNK = 1000
ROW_MOVIES = 10_000  # movies of a user that is handled in one row


def kcore(ix: DataFrame, min_user: int = 10, min_item: int = 5) -> DataFrame:
    """Drop users and movies with too few rows until nothing changes.

    Works on row counts per (user, movie). Each round removes the few failing ids by
    anti join and is checkpointed; only a row count reaches the driver. Counts fall until
    they stay, so the rounds end.
    """
    pairs = cut_lineage(ix.groupBy("user_id", "movie_id").agg(F.count("*").alias("n")))
    while True:
        thin_users = pairs.groupBy("user_id").agg(F.sum("n").alias("rows")).filter(F.col("rows") < max(min_user, 1))
        thin_items = pairs.groupBy("movie_id").agg(F.sum("n").alias("rows")).filter(F.col("rows") < max(min_item, 1))
        left = cut_lineage(
            pairs.join(thin_users.select("user_id"), "user_id", "left_anti")
            .join(thin_items.select("movie_id"), "movie_id", "left_anti")
        )
        if left.count() == pairs.count():
            return ix.join(left.select("user_id", "movie_id"), ["user_id", "movie_id"], "left_semi")
        pairs = left


def vocabulary(df: DataFrame, column: str, first_index: int = 1) -> DataFrame:
    """Dense index of the sorted distinct ids."""
    ids = df.select(F.col(column).alias("id")).filter(F.col("id").isNotNull()).distinct()
    return with_position(ids, [F.col("id").asc()], "idx", first=first_index)


def global_negatives(positives: DataFrame, ratio: int = 2, seed: int = DATASET_SEED, row_movies: int = ROW_MOVIES,
                     written: bool = False) -> DataFrame:
    """Per user ``ratio`` x positives distinct unseen movies of the positive pool, fewer if the pool ends.

    Up to six draws per wanted movie from hashed pool positions, the first accepted ones win;
    users still short are filled in pool order. A user's movies and draws meet in one row, as arrays of pool positions; a user
    with more than ``row_movies`` rows is spread over many tasks in chunks of draws instead. ``written`` positives
    are cheap to read several times.
    """
    if not written:
        positives = stored(positives.select("user_id", "movie_id"), "positives")
    pool = cut_lineage(vocabulary(positives.filter(F.col("movie_id") > 0), "movie_id", first_index=0))
    size = pool.count()
    # one row per movie: hashed, never sorted, against the far longer lists of the users
    places = broadcast_if_small(pool) if size <= 1_000_000 else pool.hint("shuffle_hash")
    known = positives.filter(F.col("user_id").isNotNull())
    busy = cut_lineage(known.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") > row_movies).select("user_id"))
    if busy.isEmpty():
        picked = _row_negatives(known, places, size, ratio, seed)
    else:
        busy = broadcast_if_small(busy)
        picked = _row_negatives(known.join(busy, "user_id", "left_anti"), places, size, ratio, seed).unionByName(
            _chunk_negatives(known.join(busy, "user_id", "left_semi"), pool, ratio, seed))
    even = F.pmod(F.col("user_id") + F.col("movie_id"), F.lit(2)) == 0
    return picked.withColumn("source", F.when(even, "two_tower").otherwise("item_similar_by_tags"))


def _row_negatives(positives: DataFrame, pool: DataFrame, size: int, ratio: int, seed: int) -> DataFrame:
    """``user_id, movie_id`` of the negatives of users with few movies: nothing but the movies and the result is shuffled."""
    place = F.col("idx")
    users = (
        positives.join(pool.withColumnRenamed("id", "movie_id"), "movie_id", "left")
        .groupBy("user_id")
        .agg(
            F.collect_set(place).alias("seen"),
            # movies outside the pool count as positives
            F.size(F.collect_set(F.when(place.isNull(), F.coalesce(F.col("movie_id").cast("string"), F.lit(""))))).alias("others"),
        )
        .select("user_id", "seen", (F.size("seen") + F.col("others")).cast("bigint").alias("n"))
    )

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _drawn(batches, size, ratio, seed)

    kind = dict(positives.dtypes)["user_id"]
    return users.mapInArrow(drawn, f"user_id {kind}, idx long").join(pool, "idx").select("user_id", F.col("id").alias("movie_id"))


def _drawn(batches: Iterator[pa.RecordBatch], size: int, ratio: int, seed: int, rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """``user_id, idx``: the chosen pool positions of users (``user_id, seen, n``); draws are those of ``functions.hashing``."""
    tails: list[bytes] = []

    def accepted(user: object, seen: set, draws: int, need: int) -> list[int]:
        """The first ``need`` accepted positions among the first ``draws`` draws."""
        tails.extend(f"|{i}|{seed}".encode() for i in range(len(tails), draws))
        head = str(user).encode()
        digests = b"".join([md5(head + t, usedforsecurity=False).digest() for t in tails[:draws]])
        # the first 15 hex digits are the first 60 bits
        places = ((np.frombuffer(digests, ">u8")[::2] >> 4) % max(size, 1)).tolist()
        return [p for p in dict.fromkeys(places) if p not in seen][:need]

    def told(users: list, chosen: list[list[int]], kind: pa.DataType) -> pa.RecordBatch:
        owner = pa.array(users, kind).take(pa.array(np.repeat(np.arange(len(users)), [len(c) for c in chosen])))
        return pa.RecordBatch.from_arrays([owner, pa.array([p for c in chosen for p in c], pa.int64())], ["user_id", "idx"])

    for batch in batches:
        users, chosen, held = [], [], 0
        for user, places, n in zip(batch["user_id"].to_pylist(), batch["seen"], batch["n"].to_pylist()):
            seen, need = set(places.as_py()), n * ratio
            # the first draws settle nearly every user; only the others go through all six per wanted movie
            picked = accepted(user, seen, math.ceil(need * 1.25) + 8, need)
            if len(picked) < need:
                picked = accepted(user, seen, need * 6, need)
            if len(picked) < need:
                # among the first (seen + picked + missing) pool movies at least ``missing`` are free: the pool is never scanned per user
                taken = seen.union(picked)
                picked += [p for p in range(min(need + n, size)) if p not in taken][: need - len(picked)]
            users.append(user)
            chosen.append(picked)
            held += need
            if held >= rows:
                yield told(users, chosen, batch["user_id"].type)
                users, chosen, held = [], [], 0
        if users:
            yield told(users, chosen, batch["user_id"].type)


def _chunk_negatives(positives: DataFrame, pool: DataFrame, ratio: int, seed: int) -> DataFrame:
    """``user_id, movie_id`` of the negatives of users with very many movies, in chunks of ``DRAWS_PER_CHUNK`` draws."""
    seen = cut_lineage(positives.distinct())
    pool_size = pool.agg(F.count("*")).scalar()
    pool = broadcast_if_small(pool)
    users = cut_lineage(seen.groupBy("user_id").agg((F.count("*") * ratio).alias("need")))
    earlier = Window.partitionBy("user_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)

    def first_accepted(wanted: DataFrame, draws: Column) -> DataFrame:
        """The first ``need`` accepted movies among the first ``draws`` draws of each user."""
        chunks = F.sequence(F.lit(0), F.ceil(draws / DRAWS_PER_CHUNK).cast("bigint") - 1)
        numbers = F.sequence(
            F.col("chunk") * DRAWS_PER_CHUNK, F.least((F.col("chunk") + 1) * DRAWS_PER_CHUNK, draws) - 1
        )
        tries = (
            wanted.withColumn("chunk", F.explode(chunks))
            .transform(lambda df: spread(df, "user_id", "chunk"))
            .withColumn("i", F.explode(numbers))
            .withColumn("idx", F.pmod(draw(code(F.col("user_id"), F.col("i"), F.lit(seed))), pool_size))
        )
        accepted = cut_lineage(
            tries.groupBy("user_id", "idx")
            .agg(F.min("i").alias("i"), F.first("need").alias("need"))
            .join(pool, "idx")
            .select("user_id", F.col("id").alias("movie_id"), "i", "need")
            .join(seen, ["user_id", "movie_id"], "left_anti")
            .withColumn("chunk", F.floor(F.col("i") / DRAWS_PER_CHUNK))
        )
        per_chunk = accepted.groupBy("user_id", "chunk").agg(F.count("*").alias("n"))
        starts = per_chunk.select("user_id", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        inside = Window.partitionBy("user_id", "chunk").orderBy("i")
        return cut_lineage(
            accepted.join(starts, ["user_id", "chunk"])
            .filter(F.col("before") < F.col("need"))
            .withColumn("rank", F.col("before") + F.row_number().over(inside))
            .filter(F.col("rank") <= F.col("need"))
            .select("user_id", "movie_id")
        )

    # the first draws settle nearly every user; only the others go through all six per wanted movie
    quick = first_accepted(users, F.ceil(F.col("need") * 1.25) + 8)
    counted = quick.groupBy("user_id").agg(F.count("*").alias("got"))
    behind = (
        users.join(counted, "user_id", "left")
        .filter(F.coalesce("got", F.lit(0)) < F.col("need"))
        .select("user_id", "need")
    )
    behind = cut_lineage(behind)
    slow = first_accepted(behind, F.col("need") * 6)
    picked = quick.join(behind, "user_id", "left_anti").unionByName(slow)

    # Short users: among the first (seen + picked + missing) pool movies at least
    # ``missing`` are free, so the pool is never scanned per user.
    got = picked.groupBy("user_id").agg(F.count("*").alias("got"))
    short = (
        users.join(got, "user_id", "left")
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .filter(F.col("got") < F.col("need"))
        .withColumn("reach", F.least(F.col("need") + F.floor(F.col("need") / ratio), pool_size))
    )
    blocks = F.sequence(F.lit(0), F.ceil(F.col("reach") / DRAWS_PER_CHUNK).cast("bigint") - 1)
    places = F.sequence(
        F.col("chunk") * DRAWS_PER_CHUNK, F.least((F.col("chunk") + 1) * DRAWS_PER_CHUNK, F.col("reach")) - 1
    )
    free = (
        short.withColumn("chunk", F.explode(blocks))
        .transform(lambda df: spread(df, "user_id", "chunk"))
        .withColumn("idx", F.explode(places))
        .join(pool, "idx")
        .select("user_id", F.col("id").alias("movie_id"), "idx", "chunk", (F.col("need") - F.col("got")).alias("missing"))
        .join(seen.unionByName(picked), ["user_id", "movie_id"], "left_anti")
    )
    free_chunks = free.groupBy("user_id", "chunk").agg(F.count("*").alias("n"))
    free_starts = free_chunks.select(
        "user_id", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    in_block = Window.partitionBy("user_id", "chunk").orderBy("idx")
    fill = (
        free.join(free_starts, ["user_id", "chunk"])
        .filter(F.col("before") < F.col("missing"))
        .withColumn("rank", F.col("before") + F.row_number().over(in_block))
        .filter(F.col("rank") <= F.col("missing"))
        .select("user_id", "movie_id")
    )
    return picked.unionByName(fill)


def with_negatives(positives: DataFrame, ratio: int = 2, seed: int = DATASET_SEED, written: bool = False) -> DataFrame:
    """Multi-task sample table: labelled positives plus sampled negatives with all labels 0."""
    if not written:
        positives = stored(positives, "positives")  # read for the draws and for the result
    zero = [F.lit(0).alias(c) for c in ("click", "collect", "comment", "rating")]
    negatives = global_negatives(positives, ratio, seed, written=True).select(
        "user_id", "movie_id", *zero, "source", F.lit(0.0).alias("recall_score")
    )
    return positives.unionByName(negatives)


def pairwise_negatives(positives: DataFrame, items: DataFrame, tries: int = 20, seed: int = VECTOR_SEED) -> DataFrame:
    """One random item per positive pair, redrawn up to ``tries`` times while it is a positive of the user.

    Nearly all pairs are settled by the first draw; only the others are expanded.
    """
    pairs = cut_lineage(positives.select("user_id", "movie_id").distinct())
    pool = cut_lineage(vocabulary(items, "movie_id", first_index=0))
    size = pool.agg(F.count("*")).scalar()
    hits = pairs.select("user_id", F.col("movie_id").alias("negative_id"), F.lit(True).alias("hit"))

    def drawn(rows: DataFrame) -> DataFrame:
        digest = code(F.col("user_id"), F.col("movie_id"), F.col("k"), F.lit(seed))
        return (
            rows.withColumn("idx", F.pmod(draw(digest), size))
            .join(pool.withColumnRenamed("id", "negative_id"), "idx")
            .drop("idx")
            .join(hits, ["user_id", "negative_id"], "left")
        )

    first = cut_lineage(drawn(pairs.withColumn("k", F.lit(0))))
    settled = first.filter(F.col("hit").isNull()).select("user_id", "movie_id", "negative_id")
    again = (
        first.filter(F.col("hit")).select("user_id", "movie_id").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    )
    # the lowest free draw; if every draw hits, the last one stays
    rank = F.when(F.col("hit").isNull() | (F.col("k") == tries), F.col("k"))
    redrawn = (
        drawn(again)
        .withColumn("rank", rank)
        .filter(F.col("rank").isNotNull())
        .groupBy("user_id", "movie_id")
        .agg(F.min(F.struct("rank", "negative_id")).alias("best"))
        .select("user_id", "movie_id", F.col("best.negative_id").alias("negative_id"))
    )
    return settled.unionByName(redrawn)


def weighted_resample(pairs: DataFrame, n: Column | int, seed: int = VECTOR_SEED) -> DataFrame:
    """``n`` draws with replacement, probability proportional to the weight (in thousandths).

    Every pair owns an interval of the running total; draws and intervals meet on a
    grid of as many cells as there are pairs.
    """
    units = pairs.select(
        "user_id", "movie_id", F.round(F.col("weight") * 1000).cast("bigint").alias("units")
    ).filter(F.col("units") > 0)
    placed = with_running_sum(units, [F.col("user_id").asc(), F.col("movie_id").asc()], {"low": "units"})
    placed = cut_lineage(placed)
    facts = placed.agg(F.sum("units").alias("total"), F.count("*").alias("pairs"))
    total, count = facts.select("total").scalar(), facts.select("pairs").scalar()
    width = F.greatest(F.ceil(total / count), F.lit(1)).cast("bigint")
    spans = placed.withColumn(
        "cell",
        F.explode(
            F.sequence(
                F.floor(F.col("low") / width).cast("bigint"),
                F.floor((F.col("low") + F.col("units") - 1) / width).cast("bigint"),
            )
        ),
    )
    wanted = count if n is None else F.lit(n)
    blocks = (
        facts.select(F.explode(F.sequence(F.lit(0), F.ceil(wanted / DRAWS_PER_CHUNK).cast("bigint") - 1)).alias("block"))
        .transform(lambda df: spread(df, "block"))
        .select(
            F.explode(
                F.sequence(
                    F.col("block") * DRAWS_PER_CHUNK,
                    F.least((F.col("block") + 1) * DRAWS_PER_CHUNK, wanted.cast("bigint")) - 1,
                )
            ).alias("draw_no")
        )
    )
    draws = blocks.withColumn("target", F.pmod(draw(code(F.col("draw_no"), F.lit(seed))), total)).withColumn(
        "cell", F.floor(F.col("target") / width).cast("bigint")
    )
    inside = (F.col("target") >= F.col("low")) & (F.col("target") < F.col("low") + F.col("units"))
    # the draws come out of one row, so the optimizer takes them for few and would broadcast them
    return draws.hint("merge").join(spans, "cell").filter(inside).select("draw_no", "user_id", "movie_id")


def leave_last_out(pairs: DataFrame) -> DataFrame:
    """fold = 'test' for the last movie of every user with two or more, else 'train'."""
    last = pairs.groupBy("user_id").agg(
        F.max(F.struct("last_ts", "weight", "movie_id"))["movie_id"].alias("held"), F.count("*").alias("n")
    )
    held = (F.col("n") >= 2) & (F.col("movie_id") == F.col("held"))
    return (
        pairs.join(last, "user_id")
        .withColumn("fold", F.when(held, "test").otherwise("train"))
        .drop("held", "n")
    )


def split(
    df: DataFrame, key: list[str], by: str | None = None, mode: str = "random", ratio: float = 0.8, seed: int = SPLIT_SEED,
    ids: DataFrame | None = None
) -> DataFrame:
    """Add ``fold``: 'random' over rows, 'stratified' per class of ``by``, 'group' over ids of ``by``.

    ``key`` must be unique per row. Rows are ordered by a hash of the key and cut exactly. A group split needs two ids;
    ``ids`` may name a shorter table with the same ones.
    """
    if mode == "group":
        found = cut_lineage((df if ids is None else ids).select(by).distinct())
        if found.limit(2).count() < 2:
            raise ValueError(f"a split by {by} needs two or more")
        # an id's hash settles the fold of its rows: one bound reaches the driver, no row is shuffled
        own = code(F.col(by), F.lit(seed))
        last = hash_cut(found.select(own.alias("_code")), "_code", [], ratio).first()["last_code"]
        rest = [c for c in df.columns if c != by]
        return df.filter(F.col(by).isNotNull()).select(by, *rest, F.when(own <= last, "train").otherwise("test").alias("fold"))
    groups = [by] if mode == "stratified" else []
    coded = df.withColumn("_code", code(*[F.col(k) for k in key], F.lit(seed)))
    last = hash_cut(coded.select(*groups, "_code"), "_code", groups, ratio)
    if groups:
        coded = coded.join(F.broadcast(last), groups)
        bound = F.col("last_code")
    else:
        bound = last.select("last_code").scalar()
    return coded.withColumn("fold", F.when(F.col("_code") <= bound, "train").otherwise("test")).drop("_code", "last_code")


def require_both_classes(df: DataFrame, label: str) -> None:
    """Raise unless both classes occur; one row with two flags is all the driver sees."""
    flags = df.agg(F.bool_or(F.col(label) > 0.5).alias("pos"), F.bool_or(F.col(label) <= 0.5).alias("neg")).first()
    if not (flags["pos"] and flags["neg"]):
        raise ValueError("both classes are required")


def label_distribution(df: DataFrame, labels: list[str], cap: float = 20.0) -> DataFrame:
    """Positives, negatives and class weight of each task."""
    counted = df.agg(*[F.count_if(F.col(c) > 0.5).alias(c) for c in labels], F.count("*").alias("n_rows"))
    per_task = F.explode(F.array(*[F.struct(F.lit(c).alias("task"), F.col(c).alias("pos")) for c in labels]))
    rows = counted.select("n_rows", per_task.alias("t")).select(
        F.col("t.task").alias("task"), F.col("t.pos").alias("pos"), (F.col("n_rows") - F.col("t.pos")).alias("neg")
    )
    weight = F.when(F.col("pos") <= 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(1.0), F.least(F.lit(float(cap)), F.col("neg") / F.col("pos")))
    )
    return rows.withColumn("weight", weight)
