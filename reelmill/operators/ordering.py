"""Exact order-based operators that never put a whole table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.session import cut_lineage


def newest(df: DataFrame, ts: str, ties: list[str], n: int, spread: int = 64) -> DataFrame:
    """The n newest rows, ties decided by the further columns.

    A count per hour finds the hour in which the n-th newest row lies, so that only
    about n rows go on. These are cut down in ``spread`` groups before the final
    ordered limit, so rows that share one hour never meet in one task.
    """
    hours = df.groupBy(F.date_trunc("HOUR", F.col(ts)).alias("hour")).agg(F.count("*").alias("n"))
    newest_first = Window.orderBy(F.col("hour").desc_nulls_last())
    enough = hours.withColumn("reached", F.sum("n").over(newest_first)).filter(F.col("reached") >= n)
    # no dated hour reached n rows: the bound is NULL and everything stays
    bound = enough.agg(F.max("hour")).scalar()
    order = [F.col(ts).desc_nulls_last(), *[F.col(c) for c in ties]]
    part = Window.partitionBy("_part").orderBy(*order)
    return (
        df.filter(bound.isNull() | (F.col(ts) >= bound))
        .withColumn("_part", F.pmod(F.xxhash64(*ties), F.lit(spread)))
        .withColumn("_rn", F.row_number().over(part))
        .filter(F.col("_rn") <= n)
        .drop("_part", "_rn")
        .orderBy(*order)
        .limit(n)
    )


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Few small rows that are about to be expanded, spread over all shuffle partitions.

    The explicit number keeps adaptive execution from packing them into one task.
    """
    return df.repartition(shuffle_width(df), *keys)


def laid_out(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """Rows written once in global order; ``_part`` and ``_row`` give each row its place."""
    n = partitions or shuffle_width(df)
    place = F.monotonically_increasing_id()
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", place)
    return cut_lineage(
        placed.withColumn("_part", F.shiftright("_place", 33))
        .withColumn("_row", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_place")
    )


def part_offsets(laid: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Sum of each measure over all earlier parts; one row per part, so always small."""
    sums = laid.groupBy("_part").agg(*[m.alias(f"_{k}") for k, m in measures.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        "_part", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"{k}_before") for k in measures]
    )


def with_position(df: DataFrame, order: list[Column], name: str = "pos", first: int = 1) -> DataFrame:
    """Dense global position in the given total order."""
    laid = laid_out(df, order)
    offsets = part_offsets(laid, {"n": F.count("*")})
    return (
        laid.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("n_before") + F.col("_row") + F.lit(first))
        .drop("_part", "_row", "n_before")
    )


def with_running_sum(df: DataFrame, order: list[Column], measures: dict[str, str]) -> DataFrame:
    """Global sum of each measure over all rows before the current one (``measures``: new name -> column)."""
    laid = laid_out(df, order)
    offsets = part_offsets(laid, {k: F.sum(c) for k, c in measures.items()})
    before = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    out = laid.join(F.broadcast(offsets), "_part")
    for k, c in measures.items():
        out = out.withColumn(k, F.col(f"{k}_before") + F.coalesce(F.sum(c).over(before), F.lit(0)))
    return out.drop("_part", "_row", *[f"{k}_before" for k in measures])


def hash_cut(df: DataFrame, code: str, by: list[str], ratio: float) -> DataFrame:
    """Per group, the code of the last row among the first ``ratio`` of rows in code order.

    ``code`` is a hex string spread evenly. Two counts over four hex digits each narrow
    the cut to rows that share eight digits, so no group is ever sorted as a whole.
    Groups of one row keep it; the cut always leaves both sides non-empty otherwise.
    """
    first, second = F.substring(F.col(code), 1, 4), F.substring(F.col(code), 5, 4)

    def crossing(counts: DataFrame, digit: str, target: Column) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(digit)
        running = counts.withColumn("upto", F.sum("n").over(order)).withColumn("target", target)
        return running.filter((F.col("upto") >= F.col("target")) & (F.col("upto") - F.col("n") < F.col("target")))

    wide = df.groupBy(*by, first.alias("d1")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    want = F.floor(total * F.lit(ratio))
    target = F.when(total <= 1, total).otherwise(F.greatest(F.lit(1), F.least(total - 1, want)))
    cut1 = crossing(wide, "d1", target).select(*by, "d1", (F.col("target") - (F.col("upto") - F.col("n"))).alias("rest"))
    near = df.select(*by, code, first.alias("d1"), second.alias("d2")).join(F.broadcast(cut1), [*by, "d1"])
    fine = near.groupBy(*by, "d2", "rest").agg(F.count("*").alias("n"))
    cut2 = crossing(fine, "d2", F.col("rest")).select(
        *by, "d2", (F.col("target") - (F.col("upto") - F.col("n"))).alias("rest")
    )
    last = near.drop("rest").join(F.broadcast(cut2), [*by, "d2"])
    order = Window.partitionBy(*by).orderBy(code)
    return (
        last.withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") == F.col("rest"))
        .select(*by, F.col(code).alias("last_code"))
    )
