"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 2000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CACHES: list[Callable[[], None]] = []  # what empties the caches that a worker keeps between tasks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row.

    A plain column used inside a lambda is inlined by the optimizer and computed again for every element.
    """
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column, gaps: str) -> Column:
    """The lower-cased (A-Z only) words of a text between matches of ``gaps``; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), gaps), "")


def pick(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under fixed names, so that extra columns of the input cannot clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def free_name(df: DataFrame) -> str:
    """A name that no column of ``df`` has."""
    return "_" + "_".join(df.columns)


def short_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch to ``BATCH_ROWS``: texts and their sets may be long, and a worker holds a batch at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Empties a worker's caches: Spark hands its workers on to later stages, which need the memory for their own work."""
    for clear in CACHES:
        clear()
    release()


def release() -> None:
    """Hands memory that Arrow freed but holds, of an earlier stage in this worker, back to the system."""
    pa.default_memory_pool().release_unused()
