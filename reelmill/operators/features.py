"""User, movie and pair features."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.functions.arrays import in_order, pad_or_truncate, top_rows
from reelmill.functions.ratings import avg_or_zero, clip, log1p_positive
from reelmill.functions.times import age_bucket, age_label, at, calendar_age, on, register_bucket
from reelmill.functions.vectors import stretches
from reelmill.operators.candidates import Facts, Rows, Sliced
from reelmill.operators.interactions import interactions
from reelmill.operators.stats import actions, alive, movie_activity, movie_rating_rollup
from reelmill.session import broadcast_if_small
from reelmill.sources.catalog import Catalog

# Lengths of the model sequences.
SHORT_HISTORY, LONG_TAGS, ITEM_TAGS = 10, 100, 12
# Order of the multi-task ranking features.
MULTITASK_FEATURES = [
    "recall_score",
    "movie_rating_avg",
    "movie_rating_count",
    "movie_comment_count",
    "movie_click_count",
    "movie_click_1h",
    "movie_click_24h",
    "movie_year",
    "movie_duration_min",
    "user_static_tag_ctr",
    "src_user_collection",
    "src_user_high_rating_similar",
    "src_user_interest_tag",
    "src_item_similar_by_tags",
    "src_two_tower",
]
# Order of the binary ranking features.
BINARY_FEATURES = [
    "recall_score",
    "has_user",
    "has_seed_movie",
    "req_n",
    "src_user_collection",
    "src_user_high_rating_similar",
    "src_user_interest_tag",
    "src_item_similar_by_tags",
    "movie_rating_avg",
    "movie_log_rating_cnt",
    "movie_year",
    "movie_duration_min",
]
# Vocabularies of the user profile.
GENDER_INDEX = {"male": 1, "female": 2}
GENDER_INDEX_MULTITASK = {"unknown": 1, "male": 2, "female": 3}
AGE_LABEL_INDEX = {"unknown": 1, "lt18": 2, "18_24": 3, "25_34": 4, "35_44": 5, "45_54": 6, "55_plus": 7}


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``ids``; AQE broadcasts the id side when it is small."""
    return df.join(ids.select(key), key, "left_semi")


def movie_base(cat: Catalog) -> DataFrame:
    return cat.movie.select(
        "movie_id",
        avg_or_zero(F.col("rating_sum"), F.col("rating_count")).alias("rating_avg"),
        "rating_count",
        "year",
        "duration_min",
    )


def item_stats(cat: Catalog, as_of: datetime | None = None) -> DataFrame:
    """The 17 numbers describing each movie, one column each, in vector order."""
    now = as_of or cat.as_of
    collected = cat.user_collect_movie.groupBy("movie_id").agg(F.count("*").alias("collects"))
    hot = (
        actions(cat)
        .filter(F.col("created_at") >= at(now - timedelta(days=30)))
        .groupBy("movie_id")
        .agg(F.count("*").alias("hot"))
    )
    stars = [f"rating_{i}_count" for i in range(1, 11)]
    votes = movie_rating_rollup(cat).select("movie_id", *stars)
    rows = (
        cat.movie.select("movie_id", "rating_sum", "rating_count", "year", "duration_min", "release_date")
        .join(votes, "movie_id", "left")
        .join(collected, "movie_id", "left")
        .join(hot, "movie_id", "left")
        .na.fill(0, [*stars, "collects", "hot"])
    )
    total = F.greatest(sum((F.col(s) for s in stars[1:]), F.col(stars[0])), F.lit(1)).cast("double")
    year = F.coalesce("year", F.lit(0)).cast("double")
    minutes = F.greatest(F.coalesce("duration_min", F.lit(0)), F.lit(0)).cast("double")
    age = F.coalesce(F.greatest(F.date_diff(on(now.date()), "release_date"), F.lit(0)), F.lit(0)).cast("double")
    # Scales of the vector entries.
    columns = [
        (avg_or_zero(F.col("rating_sum"), F.col("rating_count")) / 10.0).alias("v01_rating"),
        F.log1p(F.coalesce("rating_count", F.lit(0)).cast("double")).alias("v02_votes"),
        *[(F.col(s) / total).alias(f"v{i + 3:02d}_share_{i + 1}") for i, s in enumerate(stars)],
        F.log1p(F.col("collects").cast("double")).alias("v13_collects"),
        F.log1p(F.col("hot").cast("double")).alias("v14_hot"),
        F.when(year <= 0, F.lit(0.0)).otherwise(clip((year - 1900.0) / 200.0, 0.0, 1.5)).alias("v15_year"),
        (F.log1p(minutes) / F.log1p(F.lit(240.0))).alias("v16_duration"),
        (F.log1p(age) / F.log1p(F.lit(365.0 * 120.0))).alias("v17_age"),
    ]
    return rows.select("movie_id", *columns)


def item_stats_vector(cat: Catalog, as_of: datetime | None = None) -> DataFrame:
    rows = item_stats(cat, as_of)
    return rows.select("movie_id", F.array(*[c for c in rows.columns if c != "movie_id"]).alias("vec"))


def _ordered_tags(tags: DataFrame, n: int) -> DataFrame:
    order = [F.col("weight").desc(), F.col("hot_score").desc(), F.col("tag_id").desc()]
    return top_rows(tags, ["movie_id"], order, n).select("movie_id", "tag_id", "rank")


def static_movie_tags(cat: Catalog) -> DataFrame:
    static = cat.tag_dict.filter(F.col("type") == "static").select("tag_id")
    return cat.movie_tag.join(static, "tag_id", "left_semi")


def item_tags(cat: Catalog, n: int = ITEM_TAGS) -> DataFrame:
    rows = _ordered_tags(cat.movie_tag, n)
    return rows.groupBy("movie_id").agg(in_order("rank", "tag_id").alias("tag_ids"))


def item_static_tags(cat: Catalog, n: int = ITEM_TAGS) -> DataFrame:
    rows = _ordered_tags(static_movie_tags(cat), n)
    return rows.groupBy("movie_id").agg(in_order("rank", "tag_id").alias("tag_ids"))


def gender_name(raw: Column) -> Column:
    value = F.lower(F.trim(F.coalesce(raw, F.lit("unknown"))))
    return F.when(value.isin("male", "female"), value).otherwise("unknown")


def _index(value: Column, table: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, number in table.items():
        out = F.when(value == name, number).otherwise(out)
    return out


def profession_bucket(raw: Column, buckets: int = 64) -> Column:
    """Hashed profession, 1-based; 0 when blank."""
    text = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(text == "", 0).otherwise((F.crc32(text) % F.lit(max(buckets, 1)) + 1).cast("int"))


def user_profile(cat: Catalog, as_of: datetime | None = None, buckets: int = 64) -> DataFrame:
    """Bucketed profile of every user; the multi-task columns only know active, undeleted users."""
    now = as_of or cat.as_of
    gender = gender_name(F.col("gender"))
    usable = (F.col("status") == "active") & F.col("deleted_at").isNull()
    label = F.when(usable, age_label(calendar_age(F.col("birth"), now))).otherwise("unknown")
    return cat.user.select(
        "user_id",
        _index(gender, GENDER_INDEX, 0).alias("gender_idx"),
        age_bucket(F.col("birth"), now).alias("age_bucket"),
        register_bucket(F.col("created_at"), now).alias("register_bucket"),
        _index(F.when(usable, gender).otherwise("unknown"), GENDER_INDEX_MULTITASK, 1).alias("gender_idx_multitask"),
        label.alias("age_label"),
        _index(label, AGE_LABEL_INDEX, 1).alias("age_idx_multitask"),
        profession_bucket(F.col("profession"), buckets).alias("profession_bucket"),
    )


def recent_events(cat: Catalog, n: int) -> DataFrame:
    """Last n actions per user over all four sources, repeats kept."""
    if n <= 0:
        return interactions(cat).select("user_id", "movie_id", F.lit(1).alias("rank")).limit(0)
    order = [F.col("ts").desc_nulls_last(), F.col("movie_id").desc(), F.col("action_type").asc()]
    return top_rows(interactions(cat), ["user_id"], order, n).select("user_id", "movie_id", "rank")


def recent_sequence(cat: Catalog, n: int = 50) -> DataFrame:
    return recent_events(cat, n).groupBy("user_id").agg(in_order("rank", "movie_id").alias("movie_ids"))


def short_history(cat: Catalog, n: int = SHORT_HISTORY) -> DataFrame:
    order = [F.col("created_at").desc_nulls_last(), F.col("movie_id").desc()]
    rows = top_rows(cat.user_click.select("user_id", "movie_id", "created_at"), ["user_id"], order, n)
    return rows.groupBy("user_id").agg(in_order("rank", "movie_id").alias("movie_ids"))


def long_interest_tags(cat: Catalog, n: int = LONG_TAGS, min_rating: int = 8) -> DataFrame:
    """Static tags of lasting interest: collected ones first, then tags of highly rated movies."""
    static = cat.tag_dict.filter(F.col("type") == "static").select("tag_id")
    collected = (
        cat.user_collect_tag.filter(F.col("is_static") == 1)
        .join(static, "tag_id", "left_semi")
        .select("user_id", "tag_id", F.lit(3).alias("priority"), F.col("created_at").alias("at"))
    )
    rated = (
        cat.rating.filter(F.col("rating") >= min_rating)
        .join(static_movie_tags(cat).select("movie_id", "tag_id"), "movie_id")
        .select("user_id", "tag_id", F.lit(2).alias("priority"), F.col("updated_at").alias("at"))
    )
    merged = (
        collected.unionByName(rated)
        .groupBy("user_id", "tag_id")
        .agg(F.max("priority").alias("priority"), F.max("at").alias("at"))
    )
    order = [F.col("priority").desc(), F.col("at").desc_nulls_last(), F.col("tag_id").desc()]
    rows = top_rows(merged, ["user_id"], order, n)
    return rows.groupBy("user_id").agg(in_order("rank", "tag_id").alias("tag_ids"))


def tag_shares(cat: Catalog, candidates: DataFrame) -> DataFrame:
    """Mean share of the user's clicks that fall on each static tag of the candidate, for users with clicks and movies with tags."""
    tags = static_movie_tags(cat).select("movie_id", "tag_id")
    on_tag, total = _on_tags(cat, candidates.select("user_id").distinct())
    # pairs of users without clicks never meet their tags
    wanted = candidates.select("user_id", "movie_id").join(broadcast_if_small(total), "user_id").distinct()
    per_pair = (
        wanted.join(tags, "movie_id")
        .join(on_tag, ["user_id", "tag_id"], "left")
        .groupBy("user_id", "movie_id")
        .agg(F.sum(F.coalesce("clicks", F.lit(0))).alias("clicks"), F.count("*").alias("tags"), F.first("total").alias("total"))
    )
    return per_pair.select("user_id", "movie_id", (F.col("clicks") / F.col("total") / F.col("tags")).alias("user_static_tag_ctr"))


def static_tag_ctr(cat: Catalog, candidates: DataFrame) -> DataFrame:
    """``tag_shares`` of all candidates; 0 without clicks or tags."""
    wanted = candidates.select("user_id", "movie_id").distinct()
    return wanted.join(tag_shares(cat, candidates), ["user_id", "movie_id"], "left").withColumn(
        "user_static_tag_ctr", F.coalesce("user_static_tag_ctr", F.lit(0.0)))


def fit_zscore(df: DataFrame, columns: list[str], fixed: list[str] = ()) -> DataFrame:
    """One row of (mean, std) structs; ``fixed`` columns keep (0, 1)."""
    def facts(c: str) -> Column:
        if c in fixed:
            return F.struct(F.lit(0.0).alias("mean"), F.lit(1.0).alias("std"))
        value = F.col(c).cast("double")
        std = F.stddev_pop(value)
        return F.struct(
            F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.when(std > 1e-8, std).otherwise(F.lit(1.0)).alias("std")
        )

    return df.agg(F.struct(*[facts(c).alias(c) for c in columns]).alias("facts"))


def apply_zscore(df: DataFrame | Sliced, fitted: DataFrame, columns: list[str]) -> DataFrame | Sliced:
    """Standardise with fitted facts; missing values become 0."""
    if isinstance(df, Sliced):
        row = fitted.first()["facts"]  # two numbers a column
        at = {c: (row[c]["mean"], row[c]["std"]) for c in columns}
        return df.then(lambda rows: rows.having(**{c: (rows[c] - mean) / std for c, (mean, std) in at.items()}))
    facts = fitted.select("facts").scalar()
    return df.withColumns({
        c: F.coalesce(
            (F.col(c).cast("double") - facts.getField(c).getField("mean")) / facts.getField(c).getField("std"), F.lit(0.0)
        )
        for c in columns
    })


def movie_feature_table(cat: Catalog) -> DataFrame:
    """rating_avg, year, duration and all tags in order, one row per movie."""
    tags = (
        cat.movie_tag.groupBy("movie_id")
        .agg(F.collect_list(F.struct("weight", "hot_score", "tag_id")).alias("rows"))
        .select("movie_id", F.transform(F.sort_array("rows", asc=False), lambda s: s["tag_id"]).alias("tag_ids"))
    )
    return cat.movie.join(tags, "movie_id", "left").select(
        "movie_id",
        avg_or_zero(F.col("rating_sum"), F.col("rating_count")).alias("rating_avg"),
        F.coalesce("year", F.lit(0)).alias("year"),
        F.coalesce("duration_min", F.lit(0)).alias("duration_min"),
        F.coalesce("tag_ids", F.array().cast("array<bigint>")).alias("tag_ids"),
    )


def user_feature_table(cat: Catalog) -> DataFrame:
    tags = cat.user_collect_tag.groupBy("user_id").agg(F.sort_array(F.collect_list("tag_id")).alias("tag_ids"))
    return cat.user.join(tags, "user_id", "left").select(
        "user_id", "gender", "birth", "created_at",
        F.coalesce("tag_ids", F.array().cast("array<bigint>")).alias("tag_ids"),
    )


def source_flags(names: list[str]) -> list[Column]:
    return [(F.col("source") == n.removeprefix("src_")).cast("double").alias(n) for n in names if n.startswith("src_")]


def _on_tags(cat: Catalog, users: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Clicks per user and static tag of the movie, and all clicks per user."""
    tags = static_movie_tags(cat).select("movie_id", "tag_id")
    # clicks per (user, movie) first: a heavily clicked movie joins its tags once per user
    clicks = (cat.user_click if users is None else lookup(cat.user_click, users, "user_id")).groupBy("user_id", "movie_id").agg(
        F.count("*").alias("clicks"))
    total = clicks.groupBy("user_id").agg(F.sum("clicks").alias("total"))
    return clicks.join(tags, "movie_id").groupBy("user_id", "tag_id").agg(F.sum("clicks").alias("clicks")), total


def _shares(rows: Rows, movies: Facts, at: np.ndarray, users: Facts) -> np.ndarray:
    """``tag_shares`` of rows whose movies are at the given places; 0 without clicks or tags."""
    out = np.zeros(len(rows))
    user = users.place(rows.users)[rows.owner]
    wanted = np.flatnonzero((user < len(users.key)) & (movies.length[at] > 0))
    if not len(wanted):
        return out
    user, movie = user[wanted], at[wanted]
    count = movies.length[movie]
    tag = movies.ids[stretches(movies.start[movie], count)]
    # a user's tags and clicks lie side by side: tag, clicks, tag, clicks
    mine, whose = np.unique(user, return_inverse=True)
    n = users.length[mine] // 2
    pairs = users.ids[stretches(users.start[mine], users.length[mine])].reshape(-1, 2)
    tags = np.unique(pairs[:, 0])
    clicks = np.zeros((len(mine), len(tags) + 1), np.int64)
    clicks[np.repeat(np.arange(len(mine)), n), np.searchsorted(tags, pairs[:, 0])] = pairs[:, 1]
    column = np.minimum(np.searchsorted(tags, tag), max(len(tags) - 1, 0))
    column = np.where(tags[column] == tag, column, len(tags)) if len(tags) else np.zeros(len(tag), np.int64)
    hits = np.add.reduceat(clicks[np.repeat(whose, count), column], np.cumsum(count) - count)
    out[wanted] = hits / users.values[user, 0] / count
    return out


def _matrix_in_slices(cat: Catalog, candidates: Sliced, kind: str, as_of: datetime | None) -> Sliced:
    """``rank_matrix`` of candidates in slices: movies' features and users' clicks travel to the slices, not the pairs to them."""
    order = BINARY_FEATURES if kind == "binary" else MULTITASK_FEATURES
    of_movie = [n for n in order if n.startswith("movie_")]
    alone = cat.movie.select(
        F.lit(None).cast("long").alias("user_id"), "movie_id", F.lit(0.0).alias("recall_score"), F.lit("").alias("source"))
    facts = rank_matrix(cat, alone, kind, as_of).select("movie_id", F.array(*of_movie).alias("values"))
    shared = kind != "binary"
    if shared:
        tags = static_movie_tags(cat).groupBy("movie_id").agg(F.collect_list("tag_id").alias("ids"))
        facts = facts.join(tags, "movie_id", "left")
    nothing = F.array().cast("array<bigint>")
    facts = facts.select(F.col("movie_id").alias("id"), F.coalesce("ids", nothing).alias("ids") if shared else nothing.alias("ids"), "values")

    def known(rows: Rows, movies: Facts) -> Rows:
        at = movies.place(rows["item_id"])
        value = {n: movies.values[at, i] if len(movies.key) else np.zeros(len(rows)) for i, n in enumerate(of_movie)}
        codes, names = rows["source"]
        for n in order:
            if n.startswith("src_"):
                value[n] = np.isin(codes, [i for i, name in enumerate(names) if name == n.removeprefix("src_")]).astype(np.float64)
        value |= {"recall_score": rows["score"].astype(np.float64), "movie_id": rows["item_id"], "_at": (at, movies)}
        if not shared:
            value |= {"has_user": np.ones(len(rows)), "has_seed_movie": np.zeros(len(rows)), "req_n": np.zeros(len(rows))}
        return rows.having(**value)

    out = candidates.knowing(facts, Facts, known, movie_id="long")
    if shared:
        clicks, total = _on_tags(cat)
        pairs = clicks.groupBy("user_id").agg(F.flatten(F.collect_list(F.array("tag_id", F.col("clicks").cast("long")))).alias("ids"))
        users = total.join(pairs, "user_id", "left").select(
            F.col("user_id").alias("id"), F.coalesce("ids", nothing).alias("ids"), F.array(F.col("total").cast("double")).alias("values"))
        out = out.knowing(users, Facts, lambda rows, users: rows.having(
            user_static_tag_ctr=_shares(rows, rows["_at"][1], rows["_at"][0], users)))
    return out.only("movie_id")


def rank_matrix(
    cat: Catalog, candidates: DataFrame | Sliced, kind: str = "multitask", as_of: datetime | None = None, leak_guard: bool = False
) -> DataFrame | Sliced:
    """Ranking features in fixed order for (user_id, movie_id, recall_score, source) rows.

    ``leak_guard`` zeroes what would give the label of a training sample away:
    recall score, source flags, activity counts and click shares.
    """
    if isinstance(candidates, Sliced):
        return _matrix_in_slices(cat, candidates, kind, as_of)
    rest = [c for c in candidates.columns if c not in ("source", "recall_score", "req_n", "seed_movie_id")]
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    keys = candidates.select("movie_id").distinct()
    base = lookup(movie_base(cat), keys, "movie_id")
    if kind == "binary":
        rows = candidates.join(base, "movie_id", "left")
        seed = number("seed_movie_id") > 0 if "seed_movie_id" in candidates.columns else F.lit(False)
        values = {
            "recall_score": number("recall_score"),
            "has_user": F.col("user_id").isNotNull().cast("double"),
            "has_seed_movie": seed.cast("double"),
            "req_n": F.greatest(number("req_n"), F.lit(0.0)) if "req_n" in candidates.columns else F.lit(0.0),
            **dict(zip([n for n in BINARY_FEATURES if n.startswith("src_")], source_flags(BINARY_FEATURES))),
            "movie_rating_avg": number("rating_avg"),
            "movie_log_rating_cnt": log1p_positive(number("rating_count")),
            "movie_year": number("year"),
            "movie_duration_min": number("duration_min"),
        }
        order = BINARY_FEATURES
        hidden = ["recall_score", *[n for n in order if n.startswith("src_")]]
    else:
        activity = lookup(movie_activity(cat, as_of), keys, "movie_id")
        # the widest table meets the pairs first, while it is narrow; both other tables hold a movie once
        rows = (
            candidates.join(tag_shares(cat, candidates), ["user_id", "movie_id"], "left")
            .join(base, "movie_id", "left")
            .join(activity, "movie_id", "left")
        )
        values = {
            "recall_score": number("recall_score"),
            "movie_rating_avg": number("rating_avg"),
            "movie_rating_count": number("rating_count"),
            "movie_comment_count": number("comment_count"),
            "movie_click_count": number("click_count"),
            "movie_click_1h": number("click_1h"),
            "movie_click_24h": number("click_24h"),
            "movie_year": number("year"),
            "movie_duration_min": number("duration_min"),
            "user_static_tag_ctr": number("user_static_tag_ctr"),
            **dict(zip([n for n in MULTITASK_FEATURES if n.startswith("src_")], source_flags(MULTITASK_FEATURES))),
        }
        order = MULTITASK_FEATURES
        hidden = [n for n in order if n in ("recall_score", "user_static_tag_ctr") or "click" in n or "comment" in n
                  or n.startswith("src_")]
    if leak_guard:
        values.update({n: F.lit(0.0) for n in hidden})
    return rows.select(*rest, *[values[n].alias(n) for n in order])


def model_inputs(cat: Catalog, candidates: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Padded id sequences per candidate: short history, long-interest tags and static item tags."""
    profile = user_profile(cat, as_of).select("user_id", "gender_idx_multitask", "age_idx_multitask")
    history = short_history(cat).withColumnRenamed("movie_ids", "history")
    interests = long_interest_tags(cat).withColumnRenamed("tag_ids", "interests")
    tags = item_static_tags(cat).withColumnRenamed("tag_ids", "item_tags")
    return (
        candidates.select("user_id", "movie_id")
        .join(profile, "user_id", "left")
        .join(history, "user_id", "left")
        .join(interests, "user_id", "left")
        .join(tags, "movie_id", "left")
        .select(
            "user_id",
            "movie_id",
            F.coalesce("gender_idx_multitask", F.lit(1)).alias("gender_idx"),
            F.coalesce("age_idx_multitask", F.lit(1)).alias("age_idx"),
            pad_or_truncate(F.col("history"), SHORT_HISTORY).alias("history"),
            pad_or_truncate(F.col("interests"), LONG_TAGS).alias("interests"),
            pad_or_truncate(F.col("item_tags"), ITEM_TAGS).alias("item_tags"),
        )
    )
