"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_rows(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key; Spark prunes each input partition to n rows per key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)


def in_order(rank: str, value: str) -> Column:
    """Values of a (small, already cut) group as an array in rank order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(rank, value))), lambda s: s[value])


def pad_or_truncate(values: Column, size: int) -> Column:
    """Positive ids only, cut or filled with 0 to ``size``."""
    kept = F.filter(F.coalesce(values, F.array().cast("array<bigint>")), lambda v: v > 0)
    return F.slice(F.concat(kept, F.array_repeat(F.lit(0).cast("bigint"), size)), 1, size)
