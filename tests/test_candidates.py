"""Steps within the slices of recall against the same steps over rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmill.functions.hashing import codes
from reelmill.operators import delivery, features, interactions, ranking, samples
from reelmill.operators.candidates import apart
from reelmill.operators.recall import TagRecall, merge_candidates
from reelmill.plans import training
from reelmill.plans.queries import QUERIES, _merged_once
from reelmill.session import cut_lineage
from tests.conftest import SF


@pytest.mark.parametrize("key", ["recall_merged", "minmax_scale", "rank_fallback", "rerank_shuffle"])
def test_candidates_leave_their_slice_once(spark, key):
    plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    slices = plan.index("FlatMapGroupsInArrow")
    assert "Exchange" not in plan[:slices] and "Window" not in plan[:slices]


def test_codes_are_digests():
    rng = np.random.default_rng(3)
    for users, wide in ((np.array([0, 9, 10, 15000, 10**12]), 18), (np.array([-4, 3]), 5)):
        owner, ids = np.sort(rng.integers(0, len(users), 300)), rng.integers(0, 10 ** rng.integers(1, wide, 300))
        for seed in ("7|", "7" * 60 + "|"):
            first, second = codes(seed, users, owner, ids)
            want = [hashlib.md5(f"{seed}{users[o]}|{i}".encode()).hexdigest() for o, i in zip(owner, ids)]
            assert [f"{a:016x}{b:016x}" for a, b in zip(first.tolist(), second.tolist())] == want


@pytest.fixture(scope="module")
def parts(spark):
    """A tag recall of users 0 to 19, and rows of another recaller for users that it knows and for others before, between and after."""
    index = spark.range(400).selectExpr(
        "'genre' AS tag_type", "id % 8 AS tag_id", "CAST(id * 7 % 90 AS BIGINT) AS movie_id", "CAST(id % 5 AS DOUBLE) / 4 AS score", "CAST(id / 8 + 1 AS INT) AS rank")
    prefs = spark.range(20).selectExpr("id * 3 AS user_id", "'genre' AS tag_type", "explode(array(id % 8, id % 5)) AS tag_id").distinct()
    excluded = spark.range(150).selectExpr("id % 25 * 3 AS user_id", "id % 90 AS movie_id")
    requests = spark.range(70).withColumnRenamed("id", "user_id")
    recaller = TagRecall(index, prefs, excluded, per_key=30, n=12, multiplier=2)
    other = spark.range(800).selectExpr("id % 67 - 2 AS user_id", "id * 11 % 97 AS item_id", "CAST(id % 7 AS DOUBLE) / 4 AS score", "'vec' AS source")
    other = other.dropDuplicates(["user_id", "item_id"]).cache()
    return recaller, requests, other


def rows_of(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).toLocalIterator())


def test_steps_in_slices_equal_steps_over_rows(spark, parts):
    recaller, requests, other = parts
    sliced = merge_candidates([recaller.sliced(requests), other])
    plain = merge_candidates([recaller.recall(requests), other]).cache()
    assert rows_of(sliced.frame()) == rows_of(plain)
    assert {r.source for r in plain.select("source").distinct().toLocalIterator()} == {"vec", "tag_inverted"}
    assert rows_of(ranking.minmax(sliced, ["score"], "user_id").frame()) == rows_of(ranking.minmax(plain, ["score"], "user_id"))
    fallback = lambda rows: ranking.with_rank(ranking.FallbackRanker().rank(rows))
    assert rows_of(fallback(sliced).frame()) == rows_of(fallback(plain))
    for reranker in (delivery.SeededShuffle(4), delivery.KeepOrder()):
        for how in ("after", "before"):
            assert rows_of(delivery.deliver(sliced, reranker, 9, how).frame()) == rows_of(delivery.deliver(plain, reranker, 9, how))


def test_slices_of_one_recaller(spark, parts):
    recaller, requests, other = parts
    alone = merge_candidates([recaller.sliced(requests), other.filter("false")])
    assert rows_of(alone.frame()) == rows_of(recaller.recall(requests))
    nobody = TagRecall(recaller.index, recaller.prefs.filter("false"), recaller.excluded)
    assert rows_of(merge_candidates([nobody.sliced(requests), other]).frame()) == rows_of(other.filter(F.col("user_id").isNotNull()))


@pytest.fixture(scope="module")
def both(cat):
    """The candidates in slices and as rows."""
    sliced = _merged_once(cat)
    rows = sliced.frame().select("user_id", F.col("item_id").alias("movie_id"), F.col("score").alias("recall_score"), "source")
    return sliced, cut_lineage(rows)


def near(got, want):
    one, other = ({(r.user_id, r.item_id): (r.score, r.reason) for r in df.toLocalIterator()} for df in (got, want))
    assert one.keys() == other.keys() and len(one) > 300
    assert all(one[k][1] == other[k][1] and one[k][0] == pytest.approx(other[k][0], abs=1e-9) for k in one)
    assert len({round(v[0], 6) for v in one.values()}) > 10


def test_trees_in_slices(cat, both):
    ranker = training.train_binary(cat, rounds=6).ranker
    got, want = (ranker.rank(features.rank_matrix(cat, c, "binary")) for c in both)
    assert "Exchange" not in got.frame()._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
    near(got.frame(), want)


def test_regressions_in_slices(cat, both):
    names = features.MULTITASK_FEATURES
    matrix = cut_lineage(features.rank_matrix(cat, samples.with_negatives(interactions.multitask_labels(interactions.interactions(cat))), "multitask"))
    scaled = cut_lineage(features.fit_zscore(matrix, names, [n for n in names if n.startswith("src_")]))
    ranker = ranking.fit_multitask(features.apply_zscore(matrix, scaled, names), names, training.TASKS)
    got, want = (ranker.rank(features.apply_zscore(features.rank_matrix(cat, c, "multitask"), scaled, names)) for c in both)
    near(got.frame(), want)


def test_click_shares_in_slices(cat, both):
    sliced, rows = both
    matrix = features.rank_matrix(cat, sliced, "multitask").then(lambda r: r, user_static_tag_ctr="double", movie_year="double", movie_click_count="double")
    names = ["user_id", "movie_id", "user_static_tag_ctr", "movie_year", "movie_click_count"]
    got, want = (rows_of(df.select(*names)) for df in (matrix.frame(), features.rank_matrix(cat, rows, "multitask")))
    assert got == want and any(r[3] > 0 for r in got)


@pytest.mark.parametrize("hot, cells", [(10_000, 1 << 21), (3, 40)])
def test_item_similarity_in_slices(spark, parts, monkeypatch, hot, cells):
    recaller, requests, other = parts
    pairs = spark.range(2600).selectExpr("id % 61 AS user_id", "id * 13 % 95 AS movie_id", "CAST(id % 9 - 3 AS DOUBLE) / 5 AS weight")
    pairs = pairs.filter("user_id % 10 > 0").dropDuplicates(["user_id", "movie_id"]).cache()
    sliced = merge_candidates([recaller.sliced(requests), other])
    rows = cut_lineage(sliced.frame())
    for name, value in (("HOT", hot), ("CELLS", cells), ("HOT_BYTES", 2000)):
        monkeypatch.setattr(ranking, name, value)
    for neighbours in (4, 30):
        ranker = ranking.ItemCFRanker(pairs, neighbours)
        got = ranker.rank(sliced)
        plan = got.frame()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("FlatMapGroupsInArrow")[0]
        near(got.frame(), ranker.rank(rows))
    monkeypatch.setattr(ranking, "FEW_PAIRS", 10)
    near(ranking.ItemCFRanker(pairs, 4).rank(sliced), ranking.ItemCFRanker(pairs, 4).rank(rows))


def test_a_slice_is_a_partition(spark, parts):
    for n in (1, 7, 32):
        slices = apart(spark, n)
        rows = spark.createDataFrame([(i,) for i in slices], "u int").repartition(n, "u").select(F.spark_partition_id().alias("p"))
        assert len(slices) == n and rows.distinct().count() == n
    recaller, requests, _ = parts
    assert "REPARTITION_BY_NUM" in recaller.sliced(requests).frame()._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["rank_item_cf", "recommend_users"])
def test_ranked_candidates_leave_their_slice_once(spark, key):
    plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")] and plan.count("FlatMapGroupsInArrow") >= 1
