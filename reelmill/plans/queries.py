"""One callable per query key: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.operators import (
    delivery, documents, evaluation, evidence, features, interactions, quality, ranking, recall, reports, samples, search, stats,
    vectors,
)
from reelmill.operators.candidates import FEW_SLICES, Sliced, as_rows
from reelmill.plans import learned, training
from reelmill.plans.precompute import precompute
from reelmill.plans.recommend import Recommender
from reelmill.session import cut_lineage, fresh_path
from reelmill.sources.catalog import Catalog, from_fixture
from reelmill.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

WINDOWS = [*stats.WINDOW_DAYS, stats.ALL_TIME]


def query(name: str):
    """Register a function of the catalog under a key."""

    def register(build: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(from_fixture(spark, sf_dir))
        return build

    return register


def r6(*names: str):
    """Round doubles for comparison; sums of doubles differ in their last bits by order."""
    return {n: F.round(F.col(n), 6) for n in names}


# --- statistics ---------------------------------------------------------------


@query("trending_weekly")
def _(cat):
    return stats.trending(cat, ["weekly"]).withColumns(r6("score"))


@query("trending_all_windows")
def _(cat):
    return stats.trending(cat, WINDOWS).withColumns(r6("score"))


@query("trending_all_time")
def _(cat):
    return stats.trending(cat, [stats.ALL_TIME]).withColumns(r6("score"))


@query("search_stats")
def _(cat):
    return stats.search_stats(cat).withColumns(r6("bayesian_rating"))


@query("tag_index")
def _(cat):
    return stats.tag_index(cat).withColumns(r6("score"))


@query("movie_activity_stats")
def _(cat):
    return stats.movie_activity(cat)


@query("movie_rating_rollup")
def _(cat):
    return stats.movie_rating_rollup(cat)


# --- interactions and samples ---------------------------------------------------

STAMP = "yyyy-MM-dd HH:mm:ss"


def stamped(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.date_format(n, STAMP) for n in names})


@query("interactions_union")
def _(cat):
    return stamped(interactions.interactions(cat), "ts")


@query("interactions_recent")
def _(cat):
    return stamped(interactions.recent_interactions(interactions.interactions(cat), 300_000, 300_000), "ts")


@query("interaction_summary")
def _(cat):
    return interactions.interaction_summary(interactions.interactions(cat))


@query("cf_pair_weights")
def _(cat):
    return interactions.cf_pair_weights(interactions.interactions(cat)).withColumns(r6("weight"))


@query("implicit_pair_strength")
def _(cat):
    return stamped(interactions.implicit_strength(interactions.interactions(cat)), "last_ts").withColumns(r6("weight"))


@query("rank_labels_binary")
def _(cat):
    return stamped(interactions.binary_labels(interactions.interactions(cat), None), "ts").withColumns(r6("strength"))


@query("rank_labels_multitask")
def _(cat):
    return interactions.multitask_labels(interactions.interactions(cat))


@query("kcore_filter")
def _(cat):
    return stamped(samples.kcore(interactions.interactions(cat), min_user=38, min_item=36), "ts")


@query("negatives_global")
def _(cat):
    return samples.global_negatives(interactions.multitask_labels(interactions.interactions(cat)))


@query("negatives_pairwise")
def _(cat):
    return samples.pairwise_negatives(interactions.implicit_strength(interactions.interactions(cat)), cat.movie)


@query("weighted_resample")
def _(cat):
    return samples.weighted_resample(interactions.implicit_strength(interactions.interactions(cat)), None)


@query("holdout_last")
def _(cat):
    pairs = interactions.implicit_strength(interactions.interactions(cat))
    return samples.leave_last_out(pairs).select("user_id", "movie_id", F.round("weight", 6).alias("weight"), "fold")


def _split(cat, **how):
    # the split reads its input four times: written once
    rows = cut_lineage(interactions.binary_labels(interactions.interactions(cat), None).select("user_id", "movie_id", "label"))
    return samples.split(rows, ["user_id", "movie_id"], **how)


@query("split_random")
def _(cat):
    return _split(cat).select("user_id", "movie_id", "fold")


@query("split_stratified")
def _(cat):
    return _split(cat, by="label", mode="stratified").select("user_id", "movie_id", "label", "fold")


@query("split_group")
def _(cat):
    return _split(cat, by="user_id", mode="group").select("user_id", "movie_id", "fold")


@query("vocab_index")
def _(cat):
    ix = interactions.interactions(cat)
    parts = {
        "movie": samples.vocabulary(cat.movie.select("movie_id").unionByName(ix.select("movie_id")), "movie_id"),
        "user": samples.vocabulary(ix, "user_id"),
        "tag": samples.vocabulary(cat.movie_tag, "tag_id", first_index=2),
    }
    named = [df.select(F.lit(kind).alias("kind"), "id", "idx") for kind, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("label_distribution")
def _(cat):
    rows = interactions.multitask_labels(interactions.interactions(cat))
    return samples.label_distribution(rows, ["click", "collect", "comment", "rating"]).withColumns(r6("weight"))


# --- features ---------------------------------------------------------------------


def listed(df: DataFrame, *names: str) -> DataFrame:
    """Arrays as comma-separated text, which compares alike everywhere."""
    return df.withColumns({n: F.array_join(n, ",") for n in names})


def samples4(cat: Catalog) -> DataFrame:
    rows = interactions.multitask_labels(interactions.interactions(cat))
    return rows.select("user_id", "movie_id", "source", "recall_score")


@query("lookup_semi")
def _(cat):
    return features.lookup(cat.movie, cat.user_collect_movie, "movie_id").select("movie_id", "title", "status")


@query("movie_base_features")
def _(cat):
    return features.movie_base(cat).withColumns(r6("rating_avg"))


@query("item_stats_vector")
def _(cat):
    rows = features.item_stats(cat)
    return rows.withColumns(r6(*[c for c in rows.columns if c != "movie_id"]))


@query("item_tags_top")
def _(cat):
    return listed(features.item_tags(cat), "tag_ids")


@query("item_static_tags")
def _(cat):
    return listed(features.item_static_tags(cat), "tag_ids")


@query("user_profile_buckets")
def _(cat):
    return features.user_profile(cat).drop("profession_bucket")


@query("user_profession_bucket")
def _(cat):
    return features.user_profile(cat).select("user_id", "profession_bucket")


@query("user_recent_sequence")
def _(cat):
    return listed(features.recent_sequence(cat), "movie_ids")


@query("user_short_history")
def _(cat):
    return listed(features.short_history(cat), "movie_ids")


@query("user_long_interest_tags")
def _(cat):
    return listed(features.long_interest_tags(cat), "tag_ids")


@query("user_static_tag_ctr")
def _(cat):
    return features.static_tag_ctr(cat, samples4(cat)).withColumns(r6("user_static_tag_ctr"))


@query("feature_zscore")
def _(cat):
    names = ["rating_avg", "rating_count", "year", "duration_min", "comment_count", "click_count"]
    rows = features.movie_base(cat).join(stats.movie_activity(cat), "movie_id").select("movie_id", *names)
    return features.apply_zscore(rows, features.fit_zscore(rows, names), names).withColumns(r6(*names))


@query("feature_movie")
def _(cat):
    return listed(features.movie_feature_table(cat), "tag_ids").withColumns(r6("rating_avg"))


@query("feature_user")
def _(cat):
    return stamped(listed(features.user_feature_table(cat), "tag_ids"), "created_at")


@query("rank_matrix_multitask")
def _(cat):
    return features.rank_matrix(cat, samples4(cat)).withColumns(r6("recall_score", "movie_rating_avg", "user_static_tag_ctr"))


@query("rank_matrix_binary")
def _(cat):
    rows = samples4(cat).withColumn("req_n", F.lit(500))
    return (
        features.rank_matrix(cat, rows, "binary")
        .select("user_id", "movie_id", *features.BINARY_FEATURES)
        .withColumns(r6("recall_score", "movie_rating_avg", "movie_log_rating_cnt"))
    )


# --- recall, ranking, delivery --------------------------------------------------------


def _tag_recall(cat: Catalog) -> recall.TagRecall:
    return recall.TagRecall(
        index=stats.tag_index(cat),
        prefs=recall.top_prefs(cat),
        excluded=recall.excluded_items(cat),
    )


def _item_vectors(cat: Catalog) -> DataFrame:
    return cat.movie_embeddings.filter(F.size("vec") > 0).select("movie_id", "vec")


def _vector_recall(cat: Catalog) -> recall.VectorRecall:
    return recall.VectorRecall(users=cat.user_vectors, items=_item_vectors(cat), excluded=recall.excluded_items(cat))


def _requests(cat: Catalog) -> DataFrame:
    return cat.user.select("user_id")


def _merged_once(cat: Catalog, least: int = recall.LEAST_SLICES) -> Sliced:
    """Candidates of all users for a single reader, in the slices they are made in."""
    return recall.merge_candidates([_tag_recall(cat).sliced(_requests(cat), least), _vector_recall(cat).recall(_requests(cat))])


def _cf_ranker(cat: Catalog) -> ranking.ItemCFRanker:
    return ranking.ItemCFRanker(interactions.cf_pair_weights(interactions.interactions(cat)))


@query("user_genre_preferences")
def _(cat):
    return recall.genre_prefs(cat)


@query("user_director_preferences")
def _(cat):
    return recall.director_prefs(cat)


@query("user_top_preferences")
def _(cat):
    return recall.top_prefs(cat)


@query("user_excluded_items")
def _(cat):
    return recall.excluded_items(cat)


@query("recall_tag")
def _(cat):
    return _tag_recall(cat).recall(_requests(cat)).withColumns(r6("score"))


@query("recall_vector")
def _(cat):
    return _vector_recall(cat).recall(_requests(cat)).withColumns(r6("score"))


@query("recall_merged")
def _(cat):
    return _merged_once(cat).frame().withColumns(r6("score"))


@query("minmax_scale")
def _(cat):
    return ranking.minmax(_merged_once(cat), ["score"], "user_id").frame().withColumns(r6("score"))


@query("rank_fallback")
def _(cat):
    return ranking.with_rank(ranking.FallbackRanker().rank(_merged_once(cat))).frame().withColumns(r6("score"))


@query("rank_item_cf")
def _(cat):
    return as_rows(ranking.with_rank(_cf_ranker(cat).rank(_merged_once(cat, FEW_SLICES)))).withColumns(r6("score"))


@query("rerank_shuffle")
def _(cat):
    return delivery.deliver(_merged_once(cat), delivery.SeededShuffle(0)).frame()


def _recommended(cat: Catalog) -> DataFrame:
    flow = Recommender([_tag_recall(cat), _vector_recall(cat)], _cf_ranker(cat))
    return flow.recommend(_requests(cat))


@query("recommend_users")
def _(cat):
    return _recommended(cat)


@query("recommend_page")
def _(cat):
    return listed(delivery.page(_recommended(cat), 2, 10), "items")


# --- evaluation --------------------------------------------------------------------------


def _scores(cat: Catalog) -> DataFrame:
    return stats.search_stats(cat).select("movie_id", F.round("bayesian_rating", 6).alias("score"))


@query("auc_exact")
def _(cat):
    rows = interactions.binary_labels(interactions.interactions(cat), None).join(_scores(cat), "movie_id", "left")
    return evaluation.auc(rows.fillna(0.0, ["score"]), "label", "score").withColumns(r6("auc"))


@query("auc_by_task")
def _(cat):
    tasks = ["click", "collect", "comment", "rating"]
    rows = samples.with_negatives(interactions.multitask_labels(interactions.interactions(cat)))
    rows = rows.join(_scores(cat), "movie_id", "left").fillna(0.0, ["score"])
    long = rows.select("score", F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("label")) for t in tasks])).alias("t"))
    per_task = evaluation.auc(long.select("score", "t.task", "t.label"), "label", "score", ["task"])
    mean = evaluation.mean_auc(per_task).select(F.lit("mean").alias("task"), "auc")
    return per_task.unionByName(mean).withColumns(r6("auc"))


@query("hit_rate_at_k")
def _(cat):
    pairs = cut_lineage(samples.leave_last_out(interactions.implicit_strength(interactions.interactions(cat))))
    train, test = pairs.filter(F.col("fold") == "train"), pairs.filter(F.col("fold") == "test")
    return evaluation.hit_rate(cat.user_vectors, _item_vectors(cat), train, test).withColumns(r6("hr"))


# --- search -----------------------------------------------------------------------------------

TEXT_COLUMNS = ["movie_id", "title", "summary", "rating_count"]


def _asked(cat: Catalog) -> DataFrame:
    return cat.search_requests.filter(F.trim("query") != "").select("request_id", "query")


@query("search_browse")
def _(cat):
    p = search.normalise_request(
        tag_ids=[3, 8, 30, 8], start_date=date(2023, 3, 1), end_date=date(2023, 12, 31), duration_min=40, duration_max=180
    )
    return search.browse(cat, p).select("movie_id", "score")


@query("search_fulltext")
def _(cat):
    return search.fulltext_scores(search.searchable(cat), _asked(cat)).withColumns(r6("score"))


@query("search_like")
def _(cat):
    return search.like_scores(search.searchable(cat).select(*TEXT_COLUMNS), _asked(cat)).withColumns(r6("score"))


@query("search_auto")
def _(cat):
    return search.search_batch(cat, cat.search_requests).withColumns(r6("score"))


def _sorted_page(mode: str, order: str):
    def build(cat: Catalog) -> DataFrame:
        page, _ = search.search(cat, search.normalise_request(sort_by=mode, sort_order=order))
        return page.select("movie_id", "score", "pos")

    return build


query("search_sort_rating")(_sorted_page("rating", "desc"))
query("search_sort_collect")(_sorted_page("favourite", "desc"))
query("search_sort_duration")(_sorted_page("duration", "asc"))
query("search_sort_time")(_sorted_page("release_date", "desc"))


@query("search_page")
def _(cat):
    page, total = search.search(cat, search.normalise_request(n=7, offset=3, sort_by="rating", sort_order="asc"))
    return page.withColumn("total", total.scalar()).withColumns(r6("rating_avg", "bayesian_rating"))


@query("search_request_modes")
def _(cat):
    return search.request_modes(cat.raw_requests, cat.as_of.date())


# --- documents and evidence ------------------------------------------------------------------


def _first_value(df: DataFrame) -> DataFrame:
    return df.select("id", "movie_id", "chunk_text", F.round(F.get("vec", F.lit(0)).cast("double"), 6).alias("first_value"))


def _new_vectors(cat: Catalog) -> DataFrame:
    return cat.embeddings.select(
        (F.col("vec_id") * 3).alias("movie_id"),
        F.concat(F.lit("new "), F.col("vec_id").cast("string")).alias("chunk_text"),
        F.col("embedding").alias("vec"),
    )


def _old_vectors(cat: Catalog) -> DataFrame:
    return cat.movie_embeddings.select("id", "movie_id", "chunk_text", "vec")


@query("movie_documents")
def _(cat):
    return documents.movie_documents(cat).withColumns(r6("rating_avg"))


@query("movie_chunks")
def _(cat):
    return documents.movie_chunks(documents.movie_documents(cat))


@query("embedding_missing")
def _(cat):
    return documents.missing_embeddings(cat)


@query("embedding_prune")
def _(cat):
    kept, removed = documents.prune(cat)
    mark = lambda df, word: df.select("id", "movie_id", F.lit(word).alias("outcome"))
    return mark(kept, "kept").unionByName(mark(removed, "removed"))


@query("embedding_upsert")
def _(cat):
    return _first_value(documents.upsert(_old_vectors(cat), _new_vectors(cat)))


@query("embedding_insert_missing")
def _(cat):
    return _first_value(documents.insert_missing(_old_vectors(cat), _new_vectors(cat)))


@query("embedding_rebuild_summary")
def _(cat):
    return documents.rebuild_summary(cat, cat.movie_embeddings)


@query("embedding_normalized")
def _(cat):
    good, _ = vectors.load_vectors(cat.movie_embeddings)
    return good.select("id", "movie_id", F.posexplode("vec").alias("dim", "value")).withColumns(r6("value"))


@query("similar_items")
def _(cat):
    found = evidence.similar_items(cat, cat.movie, _item_vectors(cat), cat.item_vectors_alt)
    return found.withColumns(r6("score"))


@query("similar_items_fallback")
def _(cat):
    shown = stats.alive(stats.published(cat.movie)).select("movie_id")
    return evidence.similar_fallback(cat.movie, cat.item_vectors_alt, shown, 10).withColumns(r6("score"))


@query("rag_evidence")
def _(cat):
    return evidence.evidence(cat, cat.rag_queries).withColumns(r6("score", "rating_avg"))


@query("rag_context")
def _(cat):
    return evidence.context(evidence.evidence(cat, cat.rag_queries), cat.rag_queries)


@query("citation_audit")
def _(cat):
    found = evidence.evidence(cat, cat.rag_queries)
    return listed(evidence.audit_citations(cat.generated_answers, found, ["query_id", "variant"]), "cited_ids")


# --- reports and data quality -------------------------------------------------------------------


@query("task_report")
def _(cat):
    page, total = reports.task_report(cat.ops_task, limit=30, offset=5)
    row = total.select(F.struct("*")).scalar()
    page = page.withColumn("total", row.getField("total")).withColumn("has_more", row.getField("has_more"))
    return stamped(page, "created_at", "started_at", "finished_at")


@query("task_progress")
def _(cat):
    return reports.task_progress(cat.ops_task)


@query("qc_interactions")
def _(cat):
    return stamped(quality.bad_interactions(cat.raw_interactions), "ts")


@query("qc_keys")
def _(cat):
    return quality.key_problems(cat)


@query("qc_vectors")
def _(cat):
    return quality.bad_vectors(cat)


@query("qc_feature_coverage")
def _(cat):
    return quality.feature_coverage(cat, samples4(cat))


# --- models, precompute, streaming ------------------------------------------------------------------


@query("precompute_summary")
def _(cat):
    return precompute(cat, fresh_path(cat.spark, "precompute"))


@query("als_item_vectors")
def _(cat):
    _, items = vectors.fit_vectors(interactions.implicit_strength(interactions.interactions(cat)), dim=64)
    items = cut_lineage(items)
    cold = vectors.cold_item_vectors(items, cat.movie_tag)
    return items.withColumn("kind", F.lit("learned")).unionByName(cold.withColumn("kind", F.lit("cold")))


# the test tables are small and dense: the sizes of ``kcore_filter`` leave users and movies outside the core
CORE = {"min_user": 38, "min_item": 36}


@query("learned_folds")
def _(cat):
    return learned.core_pairs(cat, **CORE).groupBy("fold").agg(
        F.count("*").alias("n_pairs"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("movie_id").alias("n_movies"))


@query("learned_origins")
def _(cat):
    return learned.origins(learned.train_vectors(cat, **CORE))


@query("learned_recall")
def _(cat):
    return learned.train_vectors(cat, **CORE).recaller(cat).recall(_requests(cat))


@query("learned_hit_rate")
def _(cat):
    return learned.train_vectors(cat, **CORE).hit_rate()


@query("rank_gbt")
def _(cat):
    return training.train_binary(cat).ranker.rank(features.rank_matrix(cat, _candidates(cat), "binary")).frame()


@query("rank_gbt_folds")
def _(cat):
    return training.folds(training.binary_rows(cat), ["label"])


@query("rank_gbt_report")
def _(cat):
    return training.train_binary(cat).report()


@query("rank_multitask_folds")
def _(cat):
    return training.folds(training.multitask_rows(cat), training.TASKS)


@query("rank_multitask_report")
def _(cat):
    return training.train_multitask(cat).report()


def _candidates(cat: Catalog) -> Sliced:
    return _merged_once(cat, FEW_SLICES)


@query("rank_multitask")
def _(cat):
    tasks = ["click", "collect", "comment", "rating"]
    rows = samples.with_negatives(interactions.multitask_labels(interactions.interactions(cat)))
    matrix = cut_lineage(features.rank_matrix(cat, cut_lineage(rows), "multitask", leak_guard=True))
    scaled = features.fit_zscore(matrix, features.MULTITASK_FEATURES, [n for n in features.MULTITASK_FEATURES if n.startswith("src_")])
    scaled = cut_lineage(scaled)
    ranker = ranking.fit_multitask(features.apply_zscore(matrix, scaled, features.MULTITASK_FEATURES), features.MULTITASK_FEATURES, tasks)
    wanted = features.rank_matrix(cat, _candidates(cat), "multitask")
    return ranker.rank(features.apply_zscore(wanted, scaled, features.MULTITASK_FEATURES)).frame()


def _events(cat: Catalog, kinds: tuple[str, ...] | None) -> DataFrame:
    folder, schema = cat.base_folder, cat.events.schema
    raw = jobs.event_stream(cat.spark, folder, "events.parquet", schema)
    if kinds:
        raw = raw.filter(F.col("event_type").isin(*kinds))
    return raw.select("event_id", "ts", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("movie_id"))


def _run(cat: Catalog, start, *args) -> str:
    out = fresh_path(cat.spark, "stream")
    start(*args, out, fresh_path(cat.spark, "stream-state")).awaitTermination()
    return out


@query("stream_trending_counts")
def _(cat):
    kinds = ("view", "click", "signup")
    buckets = cat.spark.read.parquet(_run(cat, jobs.stream_buckets, _events(cat, kinds)))
    newest = cat.events.filter(F.col("event_type").isin(*kinds)).agg(F.max("ts").cast("timestamp").alias("ts"))
    closed = (F.unix_millis(newest.scalar()) / 1000) - 3600
    return jobs.sliding_counts(buckets, closed)


@query("stream_click_buckets")
def _(cat):
    buckets = cat.spark.read.parquet(_run(cat, jobs.stream_buckets, _events(cat, ("view", "click"))))
    return jobs.trailing_counts(buckets, cat.as_of)


@query("stream_feature_refresh")
def _(cat):
    folder = cat.base_folder
    out = _run(cat, jobs.stream_features, _events(cat, None), lambda spark: from_fixture(spark, folder))
    return listed(jobs.latest_features(cat.spark, out), "tag_ids").withColumns(r6("rating_avg"))
