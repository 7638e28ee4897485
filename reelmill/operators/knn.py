"""Exact nearest neighbours as a block-partitioned matrix product.

Queries and corpus are hashed into blocks of bounded size; one task scores one block
pair and returns k rows per query, so the shuffle after it carries
``queries x k x corpus blocks`` rows and no score matrix ever leaves a task. Scores are
made for so many queries at once that they stay below ``CELLS``, and a block has at most
``BEST_ROWS`` results, so the memory of a task depends on neither table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.functions.arrays import top_rows
from reelmill.functions.vectors import dot, id_array, norm, unit_matrix

BLOCK_ROWS = 16384
BEST_ROWS = 1 << 21
CELLS = 1 << 22
TIE = 1e-12


def block_count(df: DataFrame, block_rows: int, least: int = 1) -> int:
    return max(least, -(-df.count() // block_rows))


def query_steps(n_query: int, n_corpus: int) -> list[slice]:
    """Slices of a query block that keep the scores against a corpus block below ``CELLS``."""
    step = max(1, CELLS // max(n_corpus, 1))
    return [slice(start, start + step) for start in range(0, n_query, step)]


def meet(queries: DataFrame, corpus: DataFrame, query_key: str, corpus_key: str, block_rows: int, query_rows: int | None = None):
    """Cogroup of every query block with every corpus block."""
    n_query, n_corpus = block_count(queries, min(block_rows, query_rows or block_rows)), block_count(corpus, block_rows)
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_q", place(query_key, n_query)).withColumn("_c", all_of(n_corpus))
    # new column names: both sides may come from the same table
    right = (
        corpus.select(F.col(corpus_key).alias("_item_id"), F.col("vec").alias("_item_vec"))
        .withColumn("_c", place("_item_id", n_corpus))
        .withColumn("_q", all_of(n_query))
    )
    return left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c"))


def one_dimension(corpus: DataFrame, *others: DataFrame) -> tuple[DataFrame, ...]:
    """The tables without the rows whose vector is empty or not as long as the corpus' first one by id."""
    dim = corpus.filter(F.size("vec") > 0).agg(F.min_by(F.size("vec"), "item_id")).scalar()
    return tuple(df.filter(F.size("vec") == dim) for df in (corpus, *others))


def knn(queries: DataFrame, corpus: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Top k corpus rows per query by cosine: (query_id, vec) x (item_id, vec) -> query_id, item_id, score, rank.

    Vectors of another dimension than the corpus' are left out.
    """
    corpus, queries = one_dimension(corpus, queries)
    result = pa.schema([("query_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return result.empty_table()
        query_ids, item_ids = id_array(left["query_id"]), id_array(right["_item_id"])
        q, c = unit_matrix(left["vec"]), unit_matrix(right["_item_vec"])
        keep = min(k, len(item_ids))
        parts = []
        for part in query_steps(len(query_ids), len(item_ids)):
            scores = q[part] @ c.T
            limit = np.partition(scores, -keep, axis=1)[:, -keep]
            row, col = np.nonzero(scores >= limit[:, None])
            value = scores[row, col]
            order = np.lexsort((item_ids[col], -value, row))
            row, col, value = row[order], col[order], value[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            kept = rank < keep
            parts.append((query_ids[part][row[kept]], item_ids[col[kept]], value[kept]))
        return pa.Table.from_arrays([pa.array(np.concatenate(p)) for p in zip(*parts)], schema=result)

    per_block = meet(
        queries.select("query_id", "vec"), corpus.select("item_id", "vec"), "query_id", "item_id", block_rows,
        max(1, BEST_ROWS // k),
    ).applyInArrow(best, "query_id long, item_id long, score double")
    return top_rows(per_block, ["query_id"], [F.col("score").desc(), F.col("item_id").asc()], k)


def target_rank(
    queries: DataFrame, corpus: DataFrame, targets: DataFrame, left_out: DataFrame, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Rank of one target item per query among the corpus without the query's ``left_out`` items.

    Counts the items that beat the target, then takes away the left-out ones that do.
    No ranked list is built, so the number of left-out items per query does not matter.
    """
    with_target = (
        queries.join(targets, "query_id")
        .join(corpus.select(F.col("item_id").alias("target_id"), F.col("vec").alias("target_vec")), "target_id")
        .select("query_id", "vec", "target_id", "target_vec")
    )
    result = pa.schema([("query_id", pa.int64()), ("ahead", pa.int64())])

    def count_ahead(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return result.empty_table()
        item_ids, target_ids = id_array(right["_item_id"]), id_array(left["target_id"])
        q, t, c = unit_matrix(left["vec"]), unit_matrix(left["target_vec"]), unit_matrix(right["_item_vec"])
        ahead = []
        for part in query_steps(len(target_ids), len(item_ids)):
            gap = q[part] @ c.T - (q[part] * t[part]).sum(axis=1)[:, None]
            first = item_ids[None, :] < target_ids[part][:, None]
            other = item_ids[None, :] != target_ids[part][:, None]
            ahead.append((((gap > TIE) | ((np.abs(gap) <= TIE) & first)) & other).sum(axis=1))
        return pa.Table.from_arrays([left["query_id"].combine_chunks(), pa.array(np.concatenate(ahead))], schema=result)

    counted = (
        meet(with_target, corpus.select("item_id", "vec"), "query_id", "item_id", block_rows)
        .applyInArrow(count_ahead, "query_id long, ahead long")
        .groupBy("query_id")
        .agg(F.sum("ahead").alias("ahead"))
    )
    cosine = lambda a, b: dot(F.col(a), F.col(b)) / F.greatest(norm(F.col(a)) * norm(F.col(b)), F.lit(1e-300))
    gap = cosine("vec", "item_vec") - cosine("vec", "target_vec")
    beats = (gap > TIE) | ((F.abs(gap) <= TIE) & (F.col("item_id") < F.col("target_id")))
    removed = (
        left_out.select("query_id", "item_id")
        .distinct()
        .join(corpus.select("item_id", F.col("vec").alias("item_vec")), "item_id")
        .join(with_target, "query_id")
        .filter((F.col("item_id") != F.col("target_id")) & beats)
        .groupBy("query_id")
        .agg(F.count("*").alias("removed"))
    )
    return (
        with_target.select("query_id", "target_id")
        .join(counted, "query_id")
        .join(removed, "query_id", "left")
        .select("query_id", "target_id", (F.col("ahead") - F.coalesce("removed", F.lit(0)) + 1).alias("rank"))
    )
