"""Shape of the physical plans and of the source text."""

import pathlib
import re

import pytest

from reelmill.operators.recall import TagRecall
from reelmill.plans.queries import QUERIES
from tests.conftest import SF

ROOT = pathlib.Path(__file__).parent.parent / "reelmill"
LAZY = [
    "trending_all_windows", "tag_index", "interactions_recent", "rank_labels_multitask", "user_long_interest_tags",
    "user_static_tag_ctr", "rank_matrix_multitask", "recall_tag", "user_top_preferences", "search_fulltext",
    "movie_documents", "embedding_missing", "split_stratified", "qc_keys", "task_report",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", LAZY)
def test_no_cross_joins(spark, key):
    plan = plan_of(QUERIES[key](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_n_is_pruned_before_the_shuffle(spark):
    for key in ("trending_weekly", "tag_index", "user_excluded_items", "user_short_history"):
        assert "WindowGroupLimit" in plan_of(QUERIES[key](spark, SF)), key


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["user_short_history"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*In\(event_type, \[click,view\]\)|PushedFilters: \[[^\]]*event_type", plan)
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert scans and all("value" not in s for s in scans)


def test_library_has_no_forbidden_calls():
    for path in ROOT.rglob("*.py"):
        text = path.read_text()
        for word in (".collect()", ".toPandas(", "localCheckpoint", "crossJoin", ".rdd", "F.rand("):
            assert word not in text, f"{word} in {path}"


def test_tag_recall_keeps_one_partitioning_per_user(spark):
    index = spark.createDataFrame([("genre", 1, 10, 0.5, 1), ("genre", 1, 11, 0.4, 2), ("genre", 2, 11, 0.3, 1)],
                                  "tag_type string, tag_id long, movie_id long, score double, rank int")
    prefs = spark.createDataFrame([(7, "genre", 1), (7, "genre", 2), (8, "genre", 1)], "user_id long, tag_type string, tag_id long")
    excluded = spark.createDataFrame([(8, 10), (8, 99), (9, 11)], "user_id long, movie_id long")
    out = TagRecall(index, prefs, excluded).recall(spark.createDataFrame([(7,), (8,), (9,)], "user_id long"))
    assert not re.search(r"hashpartitioning\(user_id#\d+L, movie_id", plan_of(out))
    got = {(r.user_id, r.item_id): round(r.score, 9) for r in out.toLocalIterator()}
    assert got == {(7, 10): 0.5, (7, 11): 0.7, (8, 11): 0.4}


def test_resampled_draws_are_never_broadcast(spark):
    assert "BroadcastHashJoin [cell" not in plan_of(QUERIES["weighted_resample"](spark, SF))


def test_tag_recall_never_shuffles_a_row_per_user_and_movie(spark):
    index = spark.range(400).selectExpr("'genre' AS tag_type", "id % 4 AS tag_id", "id AS movie_id", "1.0 + id % 7 AS score", "CAST(id / 4 + 1 AS INT) AS rank")
    index = index.withColumn("score", index["score"].cast("double"))
    prefs = spark.range(60).selectExpr("id % 20 AS user_id", "'genre' AS tag_type", "id % 4 AS tag_id").distinct()
    excluded = spark.range(90).selectExpr("id % 20 AS user_id", "id AS movie_id")
    requests = spark.range(20).withColumnRenamed("id", "user_id")
    out = TagRecall(index, prefs, excluded, per_key=50, n=6, multiplier=2).recall(requests)
    assert not re.search(r"Generate (inline|explode)", plan_of(out))
    want = {}
    seen = {(r.user_id, r.movie_id) for r in excluded.toLocalIterator()}
    for p in prefs.toLocalIterator():
        for i in range(p.tag_id, 200, 4):
            if (p.user_id, i) not in seen:
                want.setdefault(p.user_id, []).append((-(1.0 + i % 7), i))
    got = {}
    for r in out.toLocalIterator():
        got.setdefault(r.user_id, []).append((-r.score, r.item_id))
    assert {u: sorted(rows) for u, rows in got.items()} == {u: sorted(rows)[:12] for u, rows in want.items()}


@pytest.mark.parametrize("key", ["recall_merged", "minmax_scale", "rank_fallback", "rerank_shuffle"])
def test_candidates_of_a_user_meet_once(spark, key):
    plan = plan_of(QUERIES[key](spark, SF))
    assert not re.search(r"hashpartitioning\(user_id#\d+L, item_id", plan)
    assert re.search(r"hashpartitioning\(user_id#\d+L, \d+\), REPARTITION_BY_COL", plan)
