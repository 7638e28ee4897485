"""Views of ``fixtures`` whose Spark form moves less than their text says; the rows are those of the text.

Ties are settled where the rows of an order already are, so later shuffles carry no column that only breaks ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TIES = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
_DAYS, _NO_MINUTE, _INTS = 43200, 1 << 17, 1 << 32


def rating(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The newest order line of every user and movie.

    An order has one last line per movie; among a user's orders only their keys are compared.
    """
    lines = lineitem.select("l_orderkey", *_TIES).repartition("l_orderkey").withColumn(
        "movie_id", F.expr("l_partkey - CASE WHEN l_partkey % 23 = 7 THEN 1 ELSE 0 END"))
    last = Window.partitionBy("l_orderkey", "movie_id").orderBy(*[F.col(c).desc() for c in _TIES])
    # minute and rating as one number, so that a row of the shuffle is two keys and two numbers
    minute, stars = F.expr("CAST((l_orderkey * 29 + l_linenumber * 13) % 43200 AS INT)"), F.expr("CAST(ceil(l_quantity / 5) AS INT)")
    code = F.coalesce(minute.cast("long") + _DAYS, F.lit(_NO_MINUTE)) * F.lit(2 * _INTS) + F.coalesce(stars.cast("long") + _INTS // 2, F.lit(_INTS))
    lines = lines.withColumn("rn", F.row_number().over(last)).filter("rn = 1").select("l_orderkey", "movie_id", code.alias("code"))
    owned = lines.join(orders.select("o_orderkey", F.col("o_custkey").alias("user_id")), F.col("l_orderkey") == F.col("o_orderkey"))
    newest = owned.groupBy("user_id", "movie_id").agg(F.max_by("code", "l_orderkey").alias("code"))
    minute, stars = F.shiftright("code", 33), F.col("code").bitwiseAND(F.lit(2 * _INTS - 1))
    return newest.select(
        "user_id", "movie_id", (F.nullif(stars, F.lit(_INTS)) - _INTS // 2).cast("int").alias("rating"),
        F.nullif(minute, F.lit(_NO_MINUTE)).alias("m")).selectExpr(
        "user_id", "movie_id", "rating",
        f"CAST('2024-01-01 00:00:00' AS TIMESTAMP_NTZ) + INTERVAL '1' MINUTE * CAST(m - {_DAYS} AS INT) AS updated_at")


def movie_person(lineitem: DataFrame) -> DataFrame:
    """Distinct over the two keys that all columns follow from."""
    pairs = lineitem.select("l_partkey", "l_suppkey").distinct()
    return pairs.selectExpr(
        "l_partkey * 100000 + l_suppkey + 1 AS movie_person_id", "l_partkey AS movie_id", "l_suppkey + 1 AS person_id",
        "CASE (l_partkey + l_suppkey) % 4 WHEN 0 THEN 'director' WHEN 3 THEN 'writer' ELSE 'actor' END AS person_role")


VIEWS = {"rating": (rating, ("lineitem", "orders")), "movie_person": (movie_person, ("lineitem",))}
