"""Jump consistent hashing of documents to shards.

A document's shard follows from its id and the number of shards alone: a 64-bit generator seeded with the id draws the
shard counts at which the document jumps to the newest shard; the last jump below the count is the place. One shard more
takes documents only into itself. All in 32-bit halves, since long arithmetic that overflows is an error in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelmill.llm.common import let, pick, shuffle_width
from reelmill.session import cut_lineage

MULTIPLIER = 2862933555777941757  # fixed value of the published generator
_MASK = (1 << 32) - 1
_LOW, _HIGH = MULTIPLIER & _MASK, MULTIPLIER >> 32


def _times(x: Column, y: int) -> Column:
    """x * y modulo 2^32 for values below 2^32."""
    return (x * (y & 0xFFFF) + F.shiftleft((x * (y >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(_MASK)


def _next(high: Column, low: Column) -> Column:
    """The next state of the generator as a struct of halves: state * MULTIPLIER + 1 modulo 2^64."""
    upper = low * (_LOW >> 16)
    lower = low * (_LOW & 0xFFFF) + F.shiftleft(upper.bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(lower, 32) + F.shiftright(upper, 16)
    top = (carry + _times(high, _LOW) + _times(low, _HIGH)).bitwiseAND(_MASK)
    return F.struct(top.alias("high"), lower.bitwiseAND(_MASK).alias("low"))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards`` - 1 of a long key.

    Jumps only go up, so ``shards`` steps always end; above 512 shards 512 steps are taken, where more jumps than that
    (ln(shards) are expected) have a probability below 1e-300.
    """
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to"),
                     F.struct(F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(_MASK).alias("low")).alias("state"))

    def step(s: Column, _: Column) -> Column:
        drawn = let(_next(s["state"]["high"], s["state"]["low"]), lambda n: F.struct(
            s["to"].alias("at"),
            F.floor((s["to"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(n["high"], 1) + 1).cast("double"))).alias("to"),
            n.alias("state")))
        return F.when(s["to"] < shards, drawn).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, 512))), start, step)["at"].cast("int")


def shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = 40) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard``: the place of every row among ``count`` and ``count + 1`` shards.

    ``size``: UTF-8 bytes of the text (null: 0) plus 16. ``slot``: rank in the shard by (id, crc, size), without gaps; equal
    rows take neighbouring slots. A null id counts as 0, a null text has the crc of no bytes.
    """
    docs = pick(df, id_col, text_col)
    raw = F.coalesce("text", F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    placed = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
                         jump_hash(key, count).alias("shard"), jump_hash(key, count + 1).alias("grown_shard"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    dealt = placed.repartitionByRange(shuffle_width(df.sparkSession), *order)  # narrow rows, ids and sizes only
    dealt = cut_lineage(dealt.withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))  # one row per shard and partition
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut_lineage(counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    within = F.row_number().over(W.partitionBy("shard", "part").orderBy(*order))
    return (
        dealt.withColumn("rank", within).join(F.broadcast(offsets), ["shard", "part"])  # shards x partitions rows
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
    )


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", count: int = 40, files: int = 8) -> None:
    """Writes all rows below ``shard=N`` folders, each of up to ``files`` files so that no shard is one task."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files))
    placed = df.withColumn("shard", jump_hash(key, count))
    placed.repartition(count * files, "shard", spread).write.partitionBy("shard").parquet(path)


def python_jump(key: int, count: int) -> int:
    """The same place by plain integers, for tests."""
    key, at, to = key % (1 << 64), -1, 0
    while to < count:
        at, key = to, (key * MULTIPLIER + 1) % (1 << 64)
        to = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at
