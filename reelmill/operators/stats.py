"""Rating statistics, activity counts, trending lists and the tag index."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.ratings import bayesian, safe_avg
from reelmill.functions.times import at
from reelmill.sources.catalog import Catalog

# Trailing windows in days.
WINDOW_DAYS = {"daily": 1, "weekly": 7, "monthly": 30, "half_year": 180, "one_year": 365}
UNKNOWN_WINDOW_DAYS = 7
ALL_TIME = "all_time"
# Weights of the trending score.
TREND_RATING, TREND_VOTES, TREND_ACTIONS = 0.55, 0.20, 0.25


def published(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "published")


def alive(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def actions(cat: Catalog) -> DataFrame:
    """Clicks and alive comments as (movie_id, created_at)."""
    clicks = cat.user_click.select("movie_id", "created_at")
    comments = alive(cat.movie_comment).select("movie_id", "created_at")
    return clicks.unionByName(comments)


def global_mean(movies: DataFrame) -> Column:
    """Mean of the per-movie averages over voted movies, as a scalar subquery."""
    voted = movies.filter(F.col("rating_count") > 0)
    return voted.agg(F.avg(safe_avg(F.col("rating_sum"), F.col("rating_count")))).scalar()


def movie_rating_rollup(cat: Catalog) -> DataFrame:
    """Histogram of votes 1..10 with sum and count; one map-side combined pass."""
    stars = [F.count_if(F.col("rating") == i).alias(f"rating_{i}_count") for i in range(1, 11)]
    return cat.rating.groupBy("movie_id").agg(
        F.sum("rating").alias("rating_sum"), F.count("rating").alias("rating_count"), *stars
    )


def collect_counts(cat: Catalog) -> DataFrame:
    return cat.user_collect_movie.groupBy("movie_id").agg(F.count("*").alias("collect_count"))


def search_stats(cat: Catalog, min_votes: int = 100) -> DataFrame:
    """collect_count and Bayesian rating of each movie that is not deleted."""
    mean = global_mean(alive(published(cat.movie)))
    movies = alive(cat.movie).select("movie_id", "rating_sum", "rating_count")
    return movies.join(collect_counts(cat), "movie_id", "left").select(
        "movie_id",
        F.coalesce("collect_count", F.lit(0)).alias("collect_count"),
        bayesian(F.col("rating_sum"), F.col("rating_count"), F.coalesce(mean, F.lit(0.0)), min_votes).alias("bayesian_rating"),
    )


def with_search_stats(cat: Catalog, min_votes: int = 100) -> DataFrame:
    """The next version of the movie table, carrying the two statistics columns."""
    return cat.movie.join(search_stats(cat, min_votes), "movie_id", "left")


def tag_index(cat: Catalog, min_votes: int = 100, depth: int = 1000) -> DataFrame:
    """Inverted index (genre tag or director) -> best movies with score and rank."""
    shown = published(cat.movie).select("movie_id", "rating_sum", "rating_count")
    mean = F.coalesce(global_mean(published(cat.movie)), F.lit(0.0))
    rated = shown.select(
        "movie_id", "rating_count", bayesian(F.col("rating_sum"), F.col("rating_count"), mean, min_votes).alias("quality")
    )
    genre = (
        cat.movie_tag.join(cat.tag_dict.select("tag_id"), "tag_id", "left_semi")
        .select(F.lit("genre").alias("tag_type"), "tag_id", "movie_id", F.coalesce("vote_up", F.lit(0)).alias("votes"))
        .join(rated.select("movie_id", "quality"), "movie_id")
    )
    director = (
        cat.movie_person.filter(F.col("person_role") == "director")
        .select(F.lit("director").alias("tag_type"), F.col("person_id").alias("tag_id"), "movie_id")
        .join(rated, "movie_id")
        .withColumnRenamed("rating_count", "votes")
    )
    scored = genre.unionByName(director).withColumn(
        "score", F.col("quality") * F.log(F.greatest(F.col("votes"), F.lit(0)).cast("double") + 1.0)
    )
    best = (
        scored.filter(F.col("score") > 0)
        .groupBy("tag_type", "tag_id", "movie_id")
        .agg(F.max("score").alias("score"))
    )
    order = Window.partitionBy("tag_type", "tag_id").orderBy(F.col("score").desc(), F.col("movie_id").desc())
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)


def window_start(window: str, as_of: datetime) -> datetime | None:
    if window == ALL_TIME:
        return None
    return as_of - timedelta(days=WINDOW_DAYS.get(window, UNKNOWN_WINDOW_DAYS))


def trending(cat: Catalog, windows: list[str], n: int = 200, as_of: datetime | None = None) -> DataFrame:
    """Top n published movies per trailing window; all windows from one pass over the facts."""
    now = as_of or cat.as_of
    timed = [w for w in windows if w != ALL_TIME]
    movies = published(cat.movie).select("movie_id", "rating_sum", "rating_count")
    parts: list[DataFrame] = []
    if timed:
        widest = min(window_start(w, now) for w in timed)
        counted = (
            actions(cat)
            .filter(F.col("created_at") >= at(widest))
            .groupBy("movie_id")
            .agg(*[F.count_if(F.col("created_at") >= at(window_start(w, now))).alias(f"n_{w}") for w in timed])
        )
        per_window = F.explode(
            F.array(*[
                F.struct(F.lit(w).alias("window"), F.coalesce(F.col(f"n_{w}"), F.lit(0)).alias("actions")) for w in timed
            ])
        )
        long = movies.join(counted, "movie_id", "left").select("movie_id", "rating_sum", "rating_count", per_window.alias("w"))
        parts.append(
            long.select(
                F.col("w.window").alias("window"),
                "movie_id",
                "rating_count",
                F.col("w.actions").alias("actions"),
                (
                    TREND_RATING * safe_avg(F.col("rating_sum"), F.col("rating_count"))
                    + TREND_VOTES * F.log10(F.coalesce("rating_count", F.lit(0)) + 1.0)
                    + TREND_ACTIONS * F.log10(F.col("w.actions") + 1.0)
                ).alias("score"),
            )
        )
    if ALL_TIME in windows:
        parts.append(
            movies.select(
                F.lit(ALL_TIME).alias("window"),
                "movie_id",
                "rating_count",
                F.lit(0).cast("bigint").alias("actions"),
                F.coalesce("rating_count", F.lit(0)).cast("double").alias("score"),
            )
        )
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    order = Window.partitionBy("window").orderBy(
        F.col("score").desc_nulls_last(),
        F.col("actions").desc(),
        F.col("rating_count").desc_nulls_last(),
        F.col("movie_id").desc(),
    )
    return (
        rows.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select("window", "movie_id", F.coalesce("score", F.lit(0.0)).alias("score"), "rank")
    )


def movie_activity(cat: Catalog, as_of: datetime | None = None) -> DataFrame:
    """Alive comments, clicks and clicks of the last 1 h / 24 h of every movie."""
    now = as_of or cat.as_of
    created = F.col("created_at")
    clicks = cat.user_click.groupBy("movie_id").agg(
        F.count("*").alias("click_count"),
        F.count_if(created >= at(now - timedelta(hours=1))).alias("click_1h"),
        F.count_if(created >= at(now - timedelta(hours=24))).alias("click_24h"),
    )
    comments = alive(cat.movie_comment).groupBy("movie_id").agg(F.count("*").alias("comment_count"))
    names = ["comment_count", "click_count", "click_1h", "click_24h"]
    return (
        cat.movie.select("movie_id")
        .join(comments, "movie_id", "left")
        .join(clicks, "movie_id", "left")
        .select("movie_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names])
    )
