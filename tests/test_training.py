"""Held-out training: splits that keep the unseen side unseen, early stop, errors of the splits."""

import random

import pytest
from pyspark.sql import functions as F

from reelmill.operators import evaluation, ranking, samples
from reelmill.plans import training
from reelmill.sources.catalog import from_fixture


def test_unseen_rows_stay_out_of_the_fit(cat):
    rows = training.multitask_rows(cat)
    users = {f: {r.user_id for r in rows.filter(F.col("fold") == f).select("user_id").distinct().collect()} for f in ("train", "test")}
    assert users["train"] and users["test"] and not users["train"] & users["test"]
    inner = training._with_validation(rows, ["user_id", "movie_id"], "user_id", "group")
    inside = {v: {r.user_id for r in inner.filter(F.col("valid") == v).select("user_id").distinct().collect()} for v in (True, False)}
    assert inside[True] and not inside[True] & inside[False] and inside[True] | inside[False] == users["train"]


def test_reports_name_every_task(spark, cat):
    binary = {r.task: r.auc for r in training.train_binary(cat, rounds=5).report().collect()}
    assert set(binary) == {"label"} and 0.3 < binary["label"] < 1.0
    several = {r.task: r.auc for r in training.train_multitask(from_fixture(spark, "/root/testdata/sf0.01"), penalties=(0.01,)).report().collect()}
    assert set(several) == {*training.TASKS, "mean"}
    assert 0.5 < several["mean"] < 1.0
    assert several["mean"] == pytest.approx(sum(several[t] for t in training.TASKS) / 4)


def test_trees_stop_early_and_learn(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("user_id"), F.col("id").alias("movie_id"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("x"))
    rows = rows.withColumn("label", ((F.col("x") > 0.5) != (F.pmod(F.xxhash64("user_id", F.lit(1)), F.lit(10)) == 0)).cast("int")).withColumn("valid", F.pmod("user_id", F.lit(10)) == 0)
    ranker = ranking.fit_gbt(rows, ["x"], rounds=50, eta=1.0, valid="valid")
    assert ranker.model.stages[-1].getNumTrees < 50
    scored = ranker.score(rows).join(rows.select(F.col("movie_id").alias("item_id"), "label"), "item_id")
    assert evaluation.auc(scored, "label", "score").first()["auc"] > 0.85


def test_splits_that_cannot_be_made(spark):
    one = spark.createDataFrame([(1, 1, 1), (1, 2, 1)], "user_id long, movie_id long, label int")
    with pytest.raises(ValueError, match="two or more"):
        samples.split(one, ["user_id", "movie_id"], "user_id", "group")
    with pytest.raises(ValueError, match="both classes"):
        samples.require_both_classes(one, "label")


def test_nearest_mean_against_plain_python(spark):
    """Masked similarity product: blocks and slices of any size, ties, negative and missing similarities."""
    draw = random.Random(11)
    wanted = sorted({(draw.randrange(6), draw.randrange(30)) for _ in range(90)})
    liked = {(draw.randrange(6), draw.randrange(40)): draw.choice([0.2, 0.6, 1.0, 2.0]) for _ in range(120)}
    similar = {(draw.randrange(30), draw.randrange(40)): draw.choice([-0.4, 0.1, 0.25, 0.25, 0.9]) for _ in range(300)}
    want = {}
    for user, item in wanted:
        mine = [(-round(similar.get((item, h), 0.0), 9), h, similar.get((item, h), 0.0), w) for (u, h), w in liked.items() if u == user]
        best = sorted(mine)[:5]
        if best:
            want[user, item] = sum(max(s, 0.0) * w for _, _, s, w in best) / sum(w for *_, w in best)
    tables = (spark.createDataFrame(wanted, "user_id long, item_id long"),
              spark.createDataFrame([(*k, w) for k, w in liked.items()], "user_id long, hist_id long, weight double"),
              spark.createDataFrame([(*k, s) for k, s in similar.items()], "item_id long, hist_id long, sim double"))
    for item_block, rows in ((2048, 1_000_000), (7, 10)):
        got = {(r.user_id, r.item_id): r.cf for r in ranking.nearest_mean(*tables, 5, item_block, rows).collect()}
        assert got == pytest.approx(want)
    assert ranking.nearest_mean(tables[0], tables[1].limit(0), tables[2], 5).collect() == []


def test_wanted_rows_and_similarities_travel_once(spark):
    """No copy of a wanted row per block of liked items, none of a similarity per slice of a small table; other columns stay."""
    wanted = spark.range(4000).selectExpr("id % 40 AS user_id", "id div 40 AS item_id", "id / 7 AS score")
    liked = spark.range(4000).selectExpr("id % 40 AS user_id", "id div 40 AS hist_id", "1.0D AS weight")
    similar = spark.range(10_000).selectExpr("id % 100 AS item_id", "id div 100 AS hist_id", "((id % 100 + id div 100) % 10) / 10 AS sim")
    got = ranking.nearest_mean(wanted, liked, similar, 30, 10, 100)
    assert got.columns == ["user_id", "item_id", "score", "cf"]
    rows = got.collect()
    assert len(rows) == 4000 and all(abs(r.cf - 0.8) < 1e-9 and abs(r.score - (r.item_id * 40 + r.user_id) / 7) < 1e-9 for r in rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and "near" not in got.columns and "flatten" not in plan


def test_co_strength_sends_a_row_once(spark):
    pairs = spark.range(3000).selectExpr("id % 50 AS user_id", "id div 50 AS movie_id", "1.0D AS weight")
    parts = ranking.co_strength(pairs, pairs, item_block=7, user_block=10, step=900, packed=True)
    assert "explode" not in parts._jdf.queryExecution().optimizedPlan().toString()
    rows = parts.collect()
    assert max(len(r.hist_ids) for r in rows) == 7
    whole = ranking.co_strength(pairs, pairs, item_block=7, user_block=10, step=900).collect()
    assert len(whole) == 3600 and all(abs(r.dot - 50) < 1e-9 for r in whole)
    assert abs(sum(sum(r.dots) for r in rows) - 3600 * 50) < 1e-6


def test_no_null_lists_go_to_python(spark):
    """Spark's Arrow writer goes back over null lists for every row of a batch: quadratic in the rows of a batch."""
    wanted = spark.range(10).selectExpr("id AS user_id", "id AS item_id")
    liked = spark.range(10).selectExpr("id AS user_id", "id AS hist_id", "1.0D AS weight")
    similar = spark.range(10).selectExpr("id AS item_id", "id AS hist_id", "0.5D AS sim")
    plan = ranking.nearest_mean(wanted, liked, similar, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "null AS _ids" not in plan and "null AS _x" not in plan and "[] AS _ids" in plan


def test_group_split_moves_no_row(spark):
    """The fold of a row follows from the hash of its id and one bound; rows without an id are left out."""
    rows = spark.range(1000).selectExpr("IF(id % 50 = 7, NULL, id % 50) AS user_id", "id AS movie_id")
    parts = samples.split(rows, ["user_id", "movie_id"], "user_id", "group")
    assert "Join" not in parts._jdf.queryExecution().optimizedPlan().toString()
    folds = {}
    for r in parts.collect():
        folds.setdefault(r.user_id, set()).add(r.fold)
    assert None not in folds and len(folds) == 49 and all(len(f) == 1 for f in folds.values())
    assert sum(f == {"train"} for f in folds.values()) in (39, 40)
    shorter = samples.split(rows, ["user_id", "movie_id"], "user_id", "group", ids=rows.select("user_id").distinct())
    assert sorted(map(str, shorter.collect())) == sorted(map(str, parts.collect()))


def test_negatives_of_a_user_in_one_row(spark):
    """A row per user draws what chunks of draws give: few movies, short pools, movies outside the pool, absent users."""
    draw = random.Random(5)
    pairs = {(u, draw.randrange(1, 400)) for u in range(30) for _ in range(draw.choice([1, 5, 60, 700]))} | {(1, -3), (2, -3), (2, -4), (None, 5)}
    positives = spark.createDataFrame(sorted(pairs, key=str), "user_id long, movie_id long")
    found = [sorted(tuple(r) for r in samples.global_negatives(positives, row_movies=n).collect()) for n in (0, 30, 10_000)]
    assert found[0] and found[0] == found[1] == found[2]
    plan = samples.global_negatives(positives)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "Window" not in plan


def test_equal_rows_are_fitted_once(spark):
    """Equal rows of features and labels are one weighted row; the model is that of the single rows; labels travel with the scores."""
    rows = spark.range(3000).selectExpr("id AS user_id", "id AS movie_id", "double(id % 7) AS x", "double(id % 5) AS z",
                                        "int(id % 7 + id % 3 > 4) AS click", "int(id % 11 = 0) AS rating")
    once = ranking.merged(rows, ["x", "z"], ["click", "rating"])
    assert once.count() <= 7 * 5 * 4 and once.agg(F.sum("n_equal")).first()[0] == 3000
    ranker = ranking.fit_multitask(rows, ["x", "z"], ["click", "rating"])
    spread_out = ranking.fit_multitask(rows.withColumn("n_equal", F.lit(1)), ["x", "z"], ["click", "rating"])
    for one, other in zip(ranker.model.stages[1:], spread_out.model.stages[1:]):
        assert list(one.coefficients) == pytest.approx(list(other.coefficients), abs=1e-4)
    scored = ranker.score(rows, ["click", "rating"])
    assert "Join" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.item_id, r.click) for r in scored.collect()) == sorted((r.movie_id, r.click) for r in rows.collect())


def test_trees_read_even_parts(spark):
    """Rows of few or uneven parts are dealt out again: no part holds more than its share."""
    rows = spark.range(0, 9000, 1, 1).selectExpr("id AS user_id", "double(id % 7) AS x", "int(id % 7 > 3) AS label")
    sizes = ranking.even_parts(rows, 500).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(sizes) == 18 and max(r["count"] for r in sizes) <= 550
    assert ranking.fit_gbt(rows, ["x"], rounds=2).score(rows.withColumn("movie_id", F.col("user_id"))).count() == 9000
