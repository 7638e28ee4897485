"""Token-id files in ORC.

Documents are dealt to ranges of their ids and written in ascending order, one file per range: integers are run-length
encoded, stripes have row indexes, and ids a Bloom filter, so readers split files by stripe and skip by metadata.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelmill.llm.common import pick, short_batches, shuffle_width
from reelmill.llm.tokens import encoder

END = 0
OPTIONS = {
    "compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true", "orc.row.index.stride": "2000", "orc.stripe.size": str(16 << 20),
}


def _encode(path: str, style: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path, style)
        for batch in batches:
            ids = [np.append(found, np.uint32(END)) for found in ids_of(batch.column("text").to_pylist())]
            ends = np.cumsum([0] + [len(i) for i in ids], dtype=np.int32)
            flat = np.concatenate(ids).view(np.int32) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["doc_id", "n_tokens", "ids"])

    return of


def write_tokens(df: DataFrame, path: str, tokenizer: str, style: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``part, row, doc_id, n_tokens, ids`` in ascending order of id, then of a hash of the text (null ids first).

    ``part`` numbers the ranges, ``row`` the documents of one. Every document ends with id 0; null texts are empty.
    """
    short_batches(df.sparkSession)
    docs = pick(df, id_col, text_col)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sorted_ = docs.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    coded = sorted_.mapInArrow(_encode(tokenizer, style), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens int, ids array<int>")
    placed = coded.select(F.spark_partition_id().alias("part"),
                          F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"), "doc_id", "n_tokens", "ids")
    placed.write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("part"), batch.column("row"), batch.column("doc_id"),
             pa.array(np.diff(ends), pa.int64()), pa.array(crcs, pa.int64())], ["part", "row", "doc_id", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the files: the place of every document in the stream of all ids.

    Parts are summed first (one row each), then ids are added up within each part.
    """
    stored = read_tokens(spark, path)
    kind = dict(stored.dtypes)["doc_id"]
    sums = stored.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per part
    firsts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = stored.mapInArrow(_checked, f"part int, row long, doc_id {kind}, n_tokens long, ids_crc32 long")
    earlier = W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    return placed.join(F.broadcast(firsts), "part").select(
        "doc_id", (F.col("first") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32")
