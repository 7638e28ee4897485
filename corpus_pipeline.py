"""Corpus pipeline: toxic documents go, copies go, leaked benchmark passages go, secrets are masked, the rest is packed.

``run`` writes every stage as Parquet below the shared folder and reads it again, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.llm import decontaminate, minhash, packing, secrets, toxicity
from reelmill.llm.common import table
from reelmill.llm.queries import WORD_TOKENIZER
from reelmill.session import fresh_path

PIECES_KEPT = 100_000  # of a generation of a worker's token cache: executors still hold memory of the stages before


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, WORD_TOKENIZER, "word", cache=PIECES_KEPT))


STAGES = [
    ("toxicity", toxic),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("masked_secrets", masked_secrets),
    ("packed", packed),
]

ORACLE_SQL = None  # learned scores and a genetic search are not SQL; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
