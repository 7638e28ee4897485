"""The registered queries of the operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.llm import (
    decontaminate, fingerprints, importance, licenses, minhash, packing, secrets, sharding, spelling, tokenfiles, toxicity, urlfilter, warc,
)
from reelmill.llm.common import table
from reelmill.session import fresh_path

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_probe(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2).select("doc_id", "n_shingles", "component_id", "kept")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted", "evidence")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = batch[["doc_id"]].copy()
        for kind in secrets.KINDS[:3]:
            out[f"n_{kind}"] = [sum(s["kind"] == kind for s in spans) for spans in batch["spans"]]
        out["base_sha256"] = [secrets.digest([s for s in spans if s["kind"] in secrets.KINDS[:3]]) for spans in batch["spans"]]
        out["spans"] = [",".join(f"{s['kind']}:{s['start']}:{s['stop']}" for s in spans) for spans in batch["spans"]]
        yield out


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.mapInPandas(_digests, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), path, BYTE_TOKENIZER, "byte")
    return tokenfiles.token_index(spark, path)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), WORD_TOKENIZER, "word"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return warc.page_rows(warc.read_archives(files, with_payload=False))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_fingerprints, op2_licenses, op3_near_duplicates, op4_shards, op5_contamination, op6_toxicity, op7_url_filter, op8_secrets,
              op9_token_files, op10_packing, op11_importance, op12_warc, op13_spelling)
}
