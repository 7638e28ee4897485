"""Preferences, exclusion sets and candidate recall."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.functions.arrays import top_rows
from reelmill.functions.vectors import flat, id_array, stretches
from reelmill.operators.candidates import Rows, Sliced, apart, merged, slice_of
from reelmill.operators.features import recent_events
from reelmill.operators.interactions import interactions
from reelmill.operators.knn import knn
from reelmill.session import cut_lineage
from reelmill.sources.catalog import Catalog

# users of a slice, least slices for that many requests, index rows summed at once
SLICE_USERS, LEAST_SLICES, FEW_USERS, CHUNK_ROWS = 16384, 32, 512, 1 << 20


class Recaller(Protocol):
    name: str

    def recall(self, requests: DataFrame) -> DataFrame:
        """Requests (user_id) -> candidates (user_id, item_id, score, source)."""


def _ranked_prefs(weighted: DataFrame, tag_type: str, n: int) -> DataFrame:
    order = [F.col("weight").desc(), F.col("tag_id").desc()]
    return top_rows(weighted, ["user_id"], order, n).select(
        "user_id", F.lit(tag_type).alias("tag_type"), "tag_id", "weight", "rank"
    )


def genre_prefs(cat: Catalog, n: int = 20, min_rating: int = 8) -> DataFrame:
    """Collected tags plus tags of highly rated movies, by count."""
    known = cat.tag_dict.select("tag_id")
    collected = cat.user_collect_tag.join(known, "tag_id", "left_semi").select("user_id", "tag_id")
    rated = (
        cat.rating.filter(F.col("rating") >= min_rating)
        .select("user_id", "movie_id")
        .join(cat.movie_tag.join(known, "tag_id", "left_semi").select("movie_id", "tag_id"), "movie_id")
        .select("user_id", "tag_id")
    )
    counted = collected.unionByName(rated).groupBy("user_id", "tag_id").agg(F.count("*").alias("weight"))
    return _ranked_prefs(counted, "genre", n)


def director_prefs(cat: Catalog, n: int = 20, recent: int = 300) -> DataFrame:
    """Directors of the user's last ``recent`` actions, by count of actions."""
    directors = cat.movie_person.filter(F.col("person_role") == "director").select("movie_id", "person_id")
    counted = (
        recent_events(cat, recent)
        .groupBy("user_id", "movie_id")
        .agg(F.count("*").alias("events"))
        .join(directors, "movie_id")
        .groupBy("user_id", F.col("person_id").alias("tag_id"))
        .agg(F.sum("events").alias("weight"))
    )
    return _ranked_prefs(counted, "director", n)


def top_prefs(cat: Catalog, n: int = 20, min_rating: int = 8, recent: int = 300) -> DataFrame:
    merged = genre_prefs(cat, n, min_rating).unionByName(director_prefs(cat, n, recent)).drop("rank")
    order = [F.col("weight").desc(), F.col("tag_id").desc(), F.col("tag_type").desc()]
    return top_rows(merged, ["user_id"], order, n)


def excluded_items(cat: Catalog, n: int = 300) -> DataFrame:
    """Newest n distinct movies per user."""
    last = interactions(cat).groupBy("user_id", "movie_id").agg(F.max("ts").alias("last_ts"))
    if n <= 0:
        return last.select("user_id", "movie_id").limit(0)
    order = [F.col("last_ts").desc_nulls_last(), F.col("movie_id").desc()]
    return top_rows(last, ["user_id"], order, n).select("user_id", "movie_id")


def _slice_hits(table: pa.Table, limit: int) -> Iterator[Rows]:
    """The ``limit`` best unseen movies of every user of a slice; some users at a time, in order of their ids."""
    asked, seen, lists = (table.filter(pc.equal(table["_k"], k)) for k in range(3))
    if asked.num_rows == 0 or lists.num_rows == 0:
        return
    length, movie = flat(lists["movies"])
    part = flat(lists["parts"])[1]
    start = np.cumsum(length) - length
    movie_ids, movie = np.unique(movie, return_inverse=True)
    at = {key: i for i, key in enumerate(zip(lists["tag_type"].to_pylist(), lists["tag_id"].to_pylist()))}
    row = np.array([at.get(key, -1) for key in zip(asked["tag_type"].to_pylist(), asked["tag_id"].to_pylist())], dtype=np.int64)
    user = id_array(asked["user_id"])[row >= 0]
    row = row[row >= 0]
    order = np.argsort(user, kind="stable")
    row = row[order]
    users, user = np.unique(user[order], return_inverse=True)
    # what a user has seen, as one sorted number per user and movie
    n_seen, gone = flat(seen["movies"])
    owner = np.repeat(id_array(seen["user_id"]), n_seen)
    u, m = np.searchsorted(users, owner), np.searchsorted(movie_ids, gone)
    known = (u < len(users)) & (m < len(movie_ids))
    u, m, owner, gone = u[known], m[known], owner[known], gone[known]
    known = (users[u] == owner) & (movie_ids[m] == gone)
    gone = np.unique(u[known] * len(movie_ids) + m[known])

    done = np.cumsum(np.bincount(user, weights=length[row], minlength=len(users))).astype(np.int64)
    first = 0
    while first < len(users):
        last = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + CHUNK_ROWS, side="right")))
        mine = slice(*np.searchsorted(user, [first, last]))
        place = stretches(start[row[mine]], length[row[mine]])
        key = np.repeat(user[mine], length[row[mine]]) * len(movie_ids) + movie[place]
        first = last
        if not len(key):
            continue
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        score, key = np.add.reduceat(part[place][order], heads), key[heads]
        if len(gone):
            near = np.minimum(np.searchsorted(gone, key), len(gone) - 1)
            score, key = score[gone[near] != key], key[gone[near] != key]
        u, m = key // len(movie_ids), key % len(movie_ids)
        rows = Rows(users, u, {"item_id": movie_ids[m], "score": score})
        if len(u) and np.bincount(u - u[0]).max() > limit:
            order = rows.sorted([-np.round(score, 9)])
            rows = rows.take(np.sort(order[rows.nth() < limit]))
        if len(rows):
            low, high = rows.owner[0], rows.owner[-1]
            yield Rows(users[low : high + 1], rows.owner - low, rows.columns)


@dataclass(frozen=True)
class TagRecall:
    """Sum of index scores over the user's preferred keys.

    Users are dealt into slices. The list of a key (at most ``per_key`` movies) travels once to every slice that wants it, not once per
    user: sums, exclusions and the cut are made within the slice, and no row per user and movie is shuffled.
    """

    index: DataFrame
    prefs: DataFrame
    excluded: DataFrame
    per_key: int = 200
    n: int = 500
    multiplier: int = 4
    name: str = "tag_inverted"

    def recall(self, requests: DataFrame) -> DataFrame:
        return self.sliced(requests).frame()

    def sliced(self, requests: DataFrame, least: int = LEAST_SLICES) -> Sliced:
        """The candidates where they are made, for steps that need only those of one user; ``least`` slices for many requests."""
        count = requests.count()
        slices = apart(requests.sparkSession, max(-(-count // SLICE_USERS), min(least, -(-count // FEW_USERS)), 1))
        place = slice_of(slices).alias("_u")
        lists = (
            self.index.filter(F.col("rank") <= self.per_key)
            .groupBy("tag_type", "tag_id")
            .agg(F.collect_list(F.struct("movie_id", "score")).alias("items"))
            .select("tag_type", "tag_id", F.col("items.movie_id").alias("movies"), F.col("items.score").alias("parts"))
        )
        # read twice: written once
        prefs = cut_lineage(
            self.prefs.join(requests.select("user_id"), "user_id", "left_semi").select(place, "user_id", "tag_type", "tag_id")
        )
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        # empty, as Spark's Arrow writer goes back over null lists for every row of a batch
        no_lists = [F.array().cast("array<bigint>").alias("movies"), F.array().cast("array<double>").alias("parts")]
        # three kinds of rows meet in a slice: preferred keys (0), seen movies (1), lists (2)
        asked = prefs.select("_u", F.lit(0).alias("_k"), "user_id", "tag_type", "tag_id", *no_lists)
        seen = self.excluded.groupBy("user_id").agg(F.collect_set("movie_id").alias("movies")).select(
            place, F.lit(1).alias("_k"), "user_id", none("string", "tag_type"), none("bigint", "tag_id"), "movies", no_lists[1])
        given = prefs.select("_u", "tag_type", "tag_id").distinct().join(lists, ["tag_type", "tag_id"]).select(
            "_u", F.lit(2).alias("_k"), none("bigint", "user_id"), "tag_type", "tag_id", "movies", "parts")
        limit = max(self.n, self.n * max(self.multiplier, 1))
        return Sliced(asked.unionByName(seen).unionByName(given), slices, lambda table: _slice_hits(table, limit), fixed={"source": self.name})


@dataclass(frozen=True)
class VectorRecall:
    """Nearest items to the user vector; exclusion comes after the cut, so fewer may remain."""

    users: DataFrame
    items: DataFrame
    excluded: DataFrame
    k: int = 300
    n: int = 300
    name: str = "two_tower"

    def recall(self, requests: DataFrame) -> DataFrame:
        queries = self.users.join(requests.select("user_id"), "user_id", "left_semi").select(
            F.col("user_id").alias("query_id"), "vec"
        )
        corpus = self.items.select(F.col("movie_id").alias("item_id"), "vec")
        drop = self.excluded.select(F.col("user_id").alias("query_id"), F.col("movie_id").alias("item_id"))
        return (
            knn(queries, corpus, max(self.k, self.n))
            .join(drop, ["query_id", "item_id"], "left_anti")
            .select(F.col("query_id").alias("user_id"), "item_id", "score", F.lit(self.name).alias("source"))
        )


def merge_candidates(parts: list[DataFrame | Sliced]) -> DataFrame | Sliced:
    """Highest score per (user, item); on ties the earlier recaller. Slices in the first place stay slices.

    A user's rows are bounded by the recallers and meet in one partition, where ranges, ranks and lists of the user follow without
    another shuffle.
    """
    first, *others = [p if isinstance(p, DataFrame) or i == 0 else p.frame() for i, p in enumerate(parts)]
    if isinstance(first, Sliced):
        return merged(first, others)
    tagged = [p.withColumn("no", F.lit(-i)) for i, p in enumerate([first, *others])]
    rows = tagged[0]
    for part in tagged[1:]:
        rows = rows.unionByName(part)
    best = rows.repartition("user_id").groupBy("user_id", "item_id").agg(F.max(F.struct("score", "no", "source")).alias("best"))
    return best.select("user_id", "item_id", F.col("best.score").alias("score"), F.col("best.source").alias("source"))
