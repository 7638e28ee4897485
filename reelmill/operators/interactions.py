"""Unified interactions, pair weights and training labels."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.operators.ordering import newest
from reelmill.operators.stats import alive
from reelmill.session import cut_lineage
from reelmill.sources.catalog import Catalog

# Strength of an action, per use.
CF_WEIGHTS = {"view": "0.2", "comment": "0.6", "collect": "1.0"}
IMPLICIT_WEIGHTS = {
    "view": "0.2", "like": "1.0", "collect": "1.2", "share": "0.8", "comment": "0.7", "dislike": "0.0",
}
RANK_WEIGHTS = {
    "view": "0.2", "like": "1.0", "collect": "1.2", "share": "0.8", "comment": "0.7", "dislike": "-0.8",
}
CF_RANGE = ("-1.0", "2.0")
# Which source wins for a (user, movie) pair.
RANK_PRIORITY = {"rating": 4, "collect": 3, "comment": 2}
# Label thresholds.
LIKED_RATING = 8
LIKED_STRENGTH = "0.8"
TASK_RATING = 5
# Fixed values: (priority, source name, recall score) of multi-task samples.
SAMPLE_SOURCES = {
    5: ("user_high_rating_similar", 1.0),
    4: ("user_collection", 1.0),
    3: ("recent_interaction", 0.9),
    2: ("recent_interaction", 0.7),
    1: ("recent_interaction", 0.6),
}

EXACT = "decimal(20,4)"


def exact(text: str) -> Column:
    """Decimal literal: sums of strengths stay exact whatever the order."""
    return F.lit(Decimal(text)).cast(EXACT)


def rating_strength() -> Column:
    return ((F.col("rating") - 5) * F.lit(Decimal("0.2"))).cast(EXACT)


def by_action(weights: dict[str, str], rating: Column) -> Column:
    """Strength of each row: the rating expression, or the fixed weight of its action."""
    out = F.when(F.col("action_type") == "rating", rating)
    for action, weight in weights.items():
        out = out.when(F.col("action_type") == action, exact(weight))
    return out


def interactions(cat: Catalog) -> DataFrame:
    """Clicks, ratings, alive comments and collections as one table."""
    no_rating = F.lit(None).cast("int").alias("rating")

    def rows(df: DataFrame, action: str, rating: Column, ts: str) -> DataFrame:
        return df.filter(F.col("movie_id").isNotNull()).select(
            "user_id", "movie_id", F.lit(action).alias("action_type"), rating, F.col(ts).alias("ts")
        )

    return (
        rows(cat.user_click, "view", no_rating, "created_at")
        .unionByName(rows(cat.rating, "rating", F.col("rating").cast("int").alias("rating"), "updated_at"))
        .unionByName(rows(alive(cat.movie_comment), "comment", no_rating, "created_at"))
        .unionByName(rows(cat.user_collect_movie, "collect", no_rating, "created_at"))
    )


def recent_interactions(ix: DataFrame, per_source: int, overall: int | None) -> DataFrame:
    """Newest rows of each source, then the newest of those."""
    ties = ["action_type", "user_id", "movie_id"]
    parts = [
        newest(ix.filter(F.col("action_type") == source), "ts", ties, per_source)
        for source in ("view", "rating", "comment", "collect")
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # at most four times per_source rows are left: written once, ordered once more
    return out if overall is None else newest(cut_lineage(out), "ts", ties, overall)


def cf_pair_weights(ix: DataFrame) -> DataFrame:
    """Clipped sum of strengths per (user, movie) for item similarity."""
    low, high = CF_RANGE
    total = F.coalesce(F.sum(by_action(CF_WEIGHTS, rating_strength())), exact("0"))  # a rating without a value adds nothing
    clipped = F.greatest(exact(low), F.least(exact(high), total))
    return ix.groupBy("user_id", "movie_id").agg(clipped.cast("double").alias("weight"))


def cf_popularity(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("movie_id").agg(F.sum(F.col("weight").cast(EXACT)).cast("double").alias("popularity"))


def is_valid() -> Column:
    """Known action, and for ratings a value from 1 to 10."""
    known = F.col("action_type").isin("rating", *IMPLICIT_WEIGHTS)
    in_range = F.coalesce(F.col("rating").between(1, 10), F.lit(False))
    return known & ((F.col("action_type") != "rating") | in_range)


def implicit_strength(ix: DataFrame) -> DataFrame:
    """Positive strength per (user, movie) with the time of the last action; invalid rows are left out."""
    positive = F.greatest(rating_strength(), exact("0"))
    return (
        ix.filter(is_valid())
        .withColumn("strength", by_action(IMPLICIT_WEIGHTS, positive))
        .filter(F.col("strength") > 0)
        .groupBy("user_id", "movie_id")
        .agg(F.sum("strength").cast("double").alias("weight"), F.max("ts").alias("last_ts"))
    )


def binary_labels(ix: DataFrame, limit: int | None = 5000) -> DataFrame:
    """One labelled row per (user, movie): the strongest source wins, then strength, then time."""
    priority = F.lit(1)
    for action, rank in RANK_PRIORITY.items():
        priority = F.when(F.col("action_type") == action, rank).otherwise(priority)
    scored = (
        ix.withColumn("strength", by_action(RANK_WEIGHTS, rating_strength()))
        .filter(F.col("strength").isNotNull())
        .select(
            "user_id",
            "movie_id",
            F.struct(
                priority.alias("priority"),
                F.abs("strength").alias("size"),
                "ts",
                "strength",
                "action_type",
                "rating",
            ).alias("row"),
        )
    )
    best = scored.groupBy("user_id", "movie_id").agg(F.max("row").alias("row"))
    liked = F.when(F.col("row.action_type") == "rating", F.col("row.rating") >= LIKED_RATING).otherwise(
        F.col("row.strength") >= exact(LIKED_STRENGTH)
    )
    rows = best.select(
        "user_id",
        "movie_id",
        F.col("row.action_type").alias("action_type"),
        F.col("row.rating").alias("rating"),
        F.col("row.strength").cast("double").alias("strength"),
        F.col("row.ts").alias("ts"),
        liked.cast("int").alias("label"),
    )
    return rows if limit is None else newest(rows, "ts", ["user_id", "movie_id"], limit)


def multitask_labels(ix: DataFrame) -> DataFrame:
    """click / collect / comment / rating labels per (user, movie) with sample source and recall score."""
    rows = ix.filter((F.col("action_type") != "rating") | F.col("rating").isNotNull())
    action = F.col("action_type")
    high = (action == "rating") & (F.col("rating") >= TASK_RATING)
    priority = (
        F.when(high, 5).when(action == "collect", 4).when(action == "comment", 3).when(action == "rating", 2).otherwise(1)
    )

    def seen(test: Column) -> Column:
        return F.max(F.when(test, 1).otherwise(0))

    source, score = F.lit(None), F.lit(None)
    for rank, (name, value) in SAMPLE_SOURCES.items():
        source = F.when(F.col("priority") == rank, name).otherwise(source)
        score = F.when(F.col("priority") == rank, value).otherwise(score)
    return (
        rows.groupBy("user_id", "movie_id")
        .agg(
            F.lit(1).alias("click"),
            seen(action == "collect").alias("collect"),
            seen(action == "comment").alias("comment"),
            seen(high).alias("rating"),
            F.max(priority).alias("priority"),
        )
        .withColumns({"source": source, "recall_score": score})
        .drop("priority")
    )


def interaction_summary(ix: DataFrame) -> DataFrame:
    """Rows, distinct users and distinct movies per action."""
    return ix.groupBy("action_type").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("movie_id").alias("movies"),
    )
