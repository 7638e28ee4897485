"""Benchmark decontamination by winnowing.

The words of documents and benchmark items are hashed, and so are their runs of ``gram`` = 5 words. Of every 6 neighbouring
runs the one of least hash is kept (winnowing), so every shared span of 10 words holds a kept run at the same place in both.
Kept runs of documents meet those of the benchmark; each meeting is extended word by word, at most 5 to either side, and
counts if 10 words agree. An item of fewer than 10 words is matched whole, by all runs of its length.
Words are compared by 64-bit hashes; ten in a row, so that unequal words do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import free_name, let, pick, words
from reelmill.session import broadcast_if_small, cut_lineage

GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SPAN = 10
POSITION_BITS = 28  # above it 35 bits of hash; a text of 2^28 words is longer than a Spark string of words


def word_hashes(text: Column) -> Column:
    return let(words(text, GAPS), lambda ws: F.transform(ws, lambda w: F.xxhash64(w)))


def _gram(hashes: Column, at: Column, size: int) -> Column:
    """Hash of a run above its position."""
    mixed = F.xxhash64(*[F.get(hashes, at + j) for j in range(size)])
    return F.shiftleft(F.shiftrightunsigned(mixed, POSITION_BITS + 1), POSITION_BITS).bitwiseOR(at.cast("long"))


def winnowed(hashes: Column, gram: int, window: int) -> Column:
    """Kept runs: the least (hash, position) of every ``window`` neighbouring runs, each once, in text order."""
    none = F.array().cast("array<bigint>")
    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - gram), lambda i: _gram(hashes, i, gram))
    if window == 1:
        return F.when(F.size(hashes) < gram, none).otherwise(runs)

    def least(r: Column) -> Column:
        lows = F.transform(F.sequence(F.lit(0), F.size(r) - window), lambda i: F.least(*[F.get(r, i + j) for j in range(window)]))
        return let(lows, lambda m: F.filter(m, lambda x, i: (i == 0) | (x != F.get(m, i - 1))))

    return F.when(F.size(hashes) < gram + window - 1, none).otherwise(let(runs, least))


def _kept(texts: DataFrame, keys: list[str], gram: int, window: int, reach: int) -> DataFrame:
    """One row per kept run: the hash, its position and the words around it, ``reach`` to either side (null beyond the text)."""
    found = texts.select(*keys, "hashes", F.explode(let(F.col("hashes"), lambda h: F.transform(
        winnowed(h, gram, window), lambda p: _run(h, p, gram, reach)))).alias("run"))
    return found.select(*keys, "run.*")


def _run(hashes: Column, packed: Column, gram: int, reach: int) -> Column:
    at = packed.bitwiseAND((1 << POSITION_BITS) - 1).cast("int")
    near = F.transform(F.sequence(F.lit(-reach), F.lit(gram + reach - 1)), lambda j: F.when(at + j >= 0, F.get(hashes, F.greatest(at + j, F.lit(0)))))
    return F.struct(F.shiftright(packed, POSITION_BITS).alias("gram"), at.alias("at"), near.alias("near"))


def _hits(docs: DataFrame, items: DataFrame, keys: list[str], gram: int, window: int, span: int) -> DataFrame:
    """Document spans ``at, stop`` that agree with an item in at least ``span`` words, with the item."""
    reach = span - gram
    theirs = _kept(items, ["item_id"], gram, window, reach).select("item_id", "gram", F.col("near").alias("item_near"))
    met = _kept(docs, keys, gram, window, reach).join(broadcast_if_small(cut_lineage(theirs.distinct())), "gram")
    same = F.transform(F.arrays_zip("near", "item_near"), lambda p: F.coalesce(p["near"] == p["item_near"], F.lit(False)))
    middle = F.forall(F.slice("same", reach + 1, gram), lambda x: x)
    run = lambda part: let(F.array_position(part, False), lambda i: F.when(i == 0, F.size(part)).otherwise(i.cast("int") - 1))
    left = run(F.reverse(F.slice("same", 1, reach))) if reach else F.lit(0)
    right = run(F.slice("same", reach + gram + 1, reach)) if reach else F.lit(0)
    return (
        met.withColumn("same", same).filter(middle)
        .select(*keys, "item_id", "at", left.alias("left"), right.alias("right"))
        .filter(F.col("left") + F.col("right") + gram >= span)
        .select(*keys, "item_id", (F.col("at") - F.col("left")).alias("at"), (F.col("at") + gram + F.col("right")).alias("stop"))
    )


def hits(docs: DataFrame, items: DataFrame, keys: list[str], span: int = SPAN, gram: int = 5) -> DataFrame:
    """Matching spans of ``docs(keys, hashes)``; ``items(item_id, hashes)`` of fewer words than ``span`` match whole."""
    short = [r[0] for r in items.select(F.size("hashes").alias("n")).filter(f"n BETWEEN 1 AND {span - 1}").distinct().toLocalIterator()]
    found = _hits(docs, items.filter(F.size("hashes") >= span), keys, gram, span - gram + 1, span)
    for n in sorted(short):  # at most span - 1 lengths
        found = found.unionByName(_hits(docs, items.filter(F.size("hashes") == n), keys, n, 1, n))
    return found


def _met(docs: DataFrame, benchmark: DataFrame, keys: list[str], item_col: str, item_text_col: str, span: int) -> DataFrame:
    items = cut_lineage(benchmark.select(F.col(item_col).cast("string").alias("item_id"), word_hashes(F.col(item_text_col)).alias("hashes")))
    hashed = docs.select(*keys, F.inline(F.array(F.struct(word_hashes(F.col("text")).alias("hashes")))))
    return hits(hashed, items, keys, span).distinct()


def without_benchmark(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", span: int = SPAN) -> DataFrame:
    """The rows that share no span with the benchmark, all columns. Equal texts share a fate, so only text hashes are joined."""
    key = F.struct(F.xxhash64(text_col).alias("a"), F.xxhash64(text_col, F.lit(1)).alias("b"))
    docs = df.select(key.alias("_text_id"), F.col(text_col).alias("text"))
    name = free_name(df)
    hit = cut_lineage(_met(docs, benchmark, ["_text_id"], item_col, item_text_col, span).select(F.col("_text_id").alias(name)).distinct())
    return df.withColumn(name, key).join(broadcast_if_small(hit), name, "left_anti").drop(name)


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, item_ids`` (ids as strings, sorted), ``contaminated``.

    A text is known by its id and a hash, so rows that repeat an id keep an answer each; null texts have no words, null ids
    are ids like others. Items with equal ids count once. No benchmark or no documents: no hits or no rows.
    """
    docs = pick(df, id_col, text_col).withColumn("_text_id", F.xxhash64("text"))
    keys = ["doc_id", "_text_id"]
    met = cut_lineage(_met(docs, benchmark, keys, item_col, item_text_col, span))
    places = met.select(*keys, F.explode(F.sequence("at", F.col("stop") - 1)).alias("place")).distinct()
    n_hit = places.groupBy(keys).agg(F.count("*").alias("n_hit"))
    ids = met.groupBy(keys).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))  # at most the benchmark
    found = n_hit.join(ids, (n_hit["doc_id"].eqNullSafe(ids["doc_id"])) & (n_hit["_text_id"] == ids["_text_id"])).select(
        n_hit["doc_id"].alias("_id"), n_hit["_text_id"].alias("_tid"), "n_hit", "item_ids")
    counted = docs.select(*keys, F.size(words(F.col("text"), GAPS)).cast("long").alias("n_words"))
    out = counted.join(found, counted["doc_id"].eqNullSafe(found["_id"]) & (counted["_text_id"] == found["_tid"]), "left")
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "_text_id", "n_words", n.alias("n_hit"),
                      F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (n > 0).alias("contaminated"))
