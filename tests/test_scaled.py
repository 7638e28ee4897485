"""Views that move less than their text: the same rows, on keys that repeat and values that are missing."""

import random

from reelmill.sources import fixtures, scaled

LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double"


def tables(spark):
    rng = random.Random(3)
    some = lambda n: rng.choice([None, *range(-2, n)])
    lines = [(some(9), some(4), some(60), some(3), rng.choice([None, 1.5, 2.5, float("nan")]), rng.choice([None, 0.0, 7.0, 50.0, -12.0]))
             for _ in range(3000)]
    orders = [(some(9), some(4)) for _ in range(40)]  # an order may have several owners
    return spark.createDataFrame(lines, LINE), spark.createDataFrame(orders, "o_orderkey long, o_custkey long")


def same(spark, name, got, **sources):
    for table, rows in sources.items():
        rows.createOrReplaceTempView(table)
    want = spark.sql(fixtures.view_text(f"fx_{name}", "spark"))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_rating(spark):
    lines, orders = tables(spark)
    same(spark, "rating", scaled.rating(lines, orders), lineitem=lines, orders=orders)


def test_movie_person(spark):
    lines, _ = tables(spark)
    same(spark, "movie_person", scaled.movie_person(lines), lineitem=lines)


def test_tie_breakers_stay_with_the_order(spark):
    lines, orders = tables(spark)
    plan = scaled.rating(lines, orders)._jdf.queryExecution().optimizedPlan().toString()
    by_user = next(p for p in plan.splitlines() if "Aggregate [user_id" in p)
    assert "l_suppkey" not in by_user and "l_extendedprice" not in by_user
    plan = scaled.movie_person(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [l_partkey" in plan  # distinct over the keys, not over what follows from them
