"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.session import cut_lineage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its smallest neighbour to its larger (``large``) or its smaller neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if large else both.filter("v < u")
    lowest = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low")).withColumnRenamed("u", "node")
    told = around.join(lowest, around["u"] == lowest["node"])
    if large:
        pairs = told.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        pairs = told.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            lowest.select(F.col("node").alias("u"), F.col("low").alias("v")))
    return pairs.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component_id`` (smallest node that can be reached) for every node of the links ``u, v``; self-links are ignored."""
    edges = cut_lineage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    digest = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == digest:
            break
        digest = tuple(now)
        if not digest[0]:
            break
        edges = cut_lineage(_stars(_stars(edges, large=True), large=False))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(roots)
