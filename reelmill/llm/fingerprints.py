"""Order MinHash fingerprints of documents.

The k-mers of a text are its runs of ``k`` UTF-8 bytes (a shorter text is one k-mer), numbered by occurrence, so that
the second ``abc`` of a text differs from the first. Every k-mer has a 33-bit hash: the upper bits name one of
``2^bin_bits`` bins, the rest is its rank in the bin; a later occurrence adds a hash of its number to the rank of the first.
In each bin the ``ell`` numbered k-mers of lowest rank are selected, put back into text order and hashed as a tuple.
The tuples of all bins are the signature: it changes when shared k-mers change places, which a set sketch misses.

Null and empty texts have an empty signature. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelmill.llm.common import let, pick, shuffle_width

POSITION_BITS = 30  # a Spark string has fewer than 2^31 bytes; the highest positions of such a text share numbers
HASH_BITS = 33
PER_BIN = 12  # ranks are cut where so many k-mers of a bin are expected; a text with a bin left short takes all k-mers


def _hash_part(packed: Column) -> Column:
    return F.shiftright(packed, POSITION_BITS)


def _bin_of(packed: Column, bin_bits: int) -> Column:
    return F.shiftright(packed, POSITION_BITS + HASH_BITS - bin_bits)


def _kmer(raw: Column, at: Column, k: int) -> Column:
    """Hash above position, never negative, of the k-mer at a place from 1."""
    low = (1 << POSITION_BITS) - 1
    return F.shiftrightunsigned(F.xxhash64(F.substring(raw, at, F.lit(k))), 1).bitwiseAND(~low & ((1 << 63) - 1)).bitwiseOR(at)


def _first_of_bins(ascending: Column, ell: int, bin_bits: int) -> Column:
    """The ``ell`` smallest elements of every bin."""
    return F.filter(ascending, lambda x, i: (i < ell) | (_bin_of(x, bin_bits) != _bin_of(F.get(ascending, i - ell), bin_bits)))


def _numbered(repeats: Column, bin_bits: int) -> Column:
    """Second and later occurrences, ascending by (hash, position), with the rank that their number gives them."""
    starts = F.filter(
        F.sequence(F.lit(0), F.size(repeats) - 1),
        lambda i: (i == 0) | (_hash_part(F.get(repeats, i)) != _hash_part(F.get(repeats, i - 1))),
    )
    runs = let(starts, lambda s: F.transform(
        s, lambda start, at: F.slice(repeats, start + 1, F.coalesce(F.get(s, at + 1), F.size(repeats)) - start)))
    last = (1 << (HASH_BITS - bin_bits)) - 1

    def moved(x: Column, n: Column) -> Column:
        rank = _hash_part(x).bitwiseAND(last)
        more = F.shiftrightunsigned(F.xxhash64(_hash_part(x), n), 64 - HASH_BITS + bin_bits)
        rank = F.least(rank + more, F.lit(last))
        return x.bitwiseAND(~(last << POSITION_BITS)).bitwiseOR(F.shiftleft(rank, POSITION_BITS))

    return F.flatten(F.transform(runs, lambda run: F.transform(run, moved)))


def selected(ascending: Column, ell: int, bin_bits: int) -> Column:
    """Lowest numbered k-mers of all bins, ascending, out of k-mers that are ascending."""
    new = lambda x, i: (i == 0) | (_hash_part(x) != _hash_part(F.get(ascending, i - 1)))
    firsts = let(F.filter(ascending, new), lambda a: F.struct(F.size(a).alias("n"), _first_of_bins(a, ell, bin_bits).alias("of")))
    return let(firsts, lambda f: F.when(f["n"] == F.size(ascending), f["of"]).otherwise(
        let(F.filter(ascending, lambda x, i: ~new(x, i)),
            lambda r: let(F.sort_array(F.concat(f["of"], _numbered(r, bin_bits))),
                          lambda a: _first_of_bins(a, ell, bin_bits)))))


def chosen(raw: Column, k: int, ell: int, bin_bits: int) -> Column:
    """Selected k-mers of a binary.

    Only ranks below a cut are sorted: a numbered k-mer never ranks below its first occurrence, so if every bin still
    finds ``ell`` of them they are the lowest of all; else all k-mers are sorted.
    """
    span, bins = 1 << (HASH_BITS - bin_bits), 1 << bin_bits
    rank_bits = ((span - 1) << POSITION_BITS) << 1  # one place higher than in a packed k-mer
    count = F.greatest(F.octet_length(raw) - k, F.lit(0)) + 1
    places = F.sequence(F.lit(1), count)
    lowest = lambda at: let(F.sort_array(F.transform(at, lambda i: _kmer(raw, i, k))), lambda a: selected(a, ell, bin_bits))
    cut = F.shiftleft((F.lit(span * PER_BIN * bins).cast("double") / count).cast("long"), POSITION_BITS + 1)
    below = let(cut, lambda c: F.filter(places, lambda i: F.xxhash64(F.substring(raw, i, F.lit(k))).bitwiseAND(rank_bits) < c))
    return (
        F.when(F.octet_length(raw) == 0, F.array().cast("array<bigint>"))
        .when(count <= PER_BIN * bins, lowest(places))
        .otherwise(let(lowest(below), lambda found: F.when(F.size(found) == ell * bins, found).otherwise(lowest(places))))
    )


def signature(found: Column, bin_bits: int) -> Column:
    """Per bin with k-mers its number above 32 bits of the hash of its k-mers in text order."""
    in_bin = lambda x: _bin_of(x, bin_bits)
    starts = F.filter(F.transform(found, lambda x, i: i), lambda i: (i == 0) | (in_bin(F.get(found, i)) != in_bin(F.get(found, i - 1))))

    def of(mine: Column) -> Column:
        turned = F.sort_array(F.transform(mine, lambda x: F.struct(
            x.bitwiseAND((1 << POSITION_BITS) - 1).alias("position"), _hash_part(x).alias("kmer"))))
        mixed = F.xxhash64(F.transform(turned, lambda s: s["kmer"]))
        return F.shiftleft(in_bin(mine[0]), 32).bitwiseOR(F.shiftrightunsigned(mixed, 32))

    return let(starts, lambda s: F.transform(s, lambda start, at: let(
        F.slice(found, start + 1, F.coalesce(F.get(s, at + 1), F.size(found)) - start), of)))


def as_text(sig: Column) -> Column:
    """Twelve hex digits per bin, ascending."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 12, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among the bins that either signature has; two empty signatures are alike."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    return let(F.size(F.array_union(bins(a), bins(b))), lambda used: F.when(used == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)) / used))


def text_signature(text: Column, k: int, ell: int, bin_bits: int) -> Column:
    return let(let(F.coalesce(text, F.lit("")).cast("binary"), lambda raw: chosen(raw, k, ell, bin_bits)),
               lambda found: signature(found, bin_bits))


def doc_buckets(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents with the number of their id range; ranges come from approximate quantiles of the ids alone.

    One row with one id per shuffle partition reaches the driver. Equal ids share a range; null ids are in the first.
    """
    width = shuffle_width(docs.sparkSession)
    cuts = [i / width for i in range(1, width)] or [0.5]
    row = docs.agg(F.percentile_approx("doc_id", cuts, 10 * width).alias("cuts")).first()
    found = sorted(set(row["cuts"] or []))
    step = max(1, int(len(found) ** 0.5))
    groups = [found[i : i + step] for i in range(0, len(found), step)]
    if not groups:
        return docs.withColumn("_range", F.lit(0)), 1
    typed = lambda xs: F.array(*[F.lit(x) for x in xs])
    heads, table = typed([g[0] for g in groups]), F.array(*[typed(g) for g in groups])
    at = F.coalesce(F.size(F.filter(heads, lambda c: c <= F.col("doc_id"))), F.lit(0))
    inner = let(at, lambda g: F.when(g == 0, F.lit(0)).otherwise(
        (g - 1) * step + F.size(F.filter(F.get(table, g - 1), lambda c: c <= F.col("doc_id")))))
    return docs.withColumn("_range", F.when(F.col("doc_id").isNull(), 0).otherwise(inner)), len(found) + 1


def with_next(docs: DataFrame) -> DataFrame:
    """Every document together with the text of the next one by (doc_id, text), the last with that of the first.

    Texts are shuffled once, by id range; the first document of a range also goes to the range before it. Rows with
    ``_halo`` are those copies.
    """
    ranged, _ = doc_buckets(docs.withColumn("_tie", F.xxhash64("text")))
    order = F.struct(F.col("doc_id"), F.col("_tie"))
    firsts = list(ranged.groupBy("_range").agg(F.min(order).alias("first")).orderBy("_range").toLocalIterator())  # one row per range
    ranged = ranged.withColumn("_halo", F.lit(False))
    if not firsts:
        return ranged.withColumns({"next_text": F.lit(None).cast("string"), "_wraps": F.lit(False)})
    places = [r["_range"] for r in firsts]
    to = spark_rows(docs, [(r["first"]["doc_id"], r["first"]["_tie"], places[i - 1] if i else places[-1], i == 0)
                           for i, r in enumerate(firsts)])
    key = ranged["doc_id"].eqNullSafe(to["_id"]) & (ranged["_tie"] == to["_first_tie"])
    halo = (
        ranged.join(F.broadcast(to), key)  # one row per range
        .dropDuplicates(["_to", "doc_id", "_tie"])
        .select("doc_id", "text", "_tie", F.col("_to").alias("_range"), F.lit(True).alias("_halo"), "_wraps")
    )
    both = ranged.withColumn("_wraps", F.lit(False)).select(halo.columns).unionByName(halo)
    return both.withColumn("next_text", F.lead("text").over(in_range()))


def in_range():
    return W.partitionBy("_range").orderBy("_wraps", F.col("doc_id").asc_nulls_first(), "_halo", "_tie")


def spark_rows(df: DataFrame, rows: list[tuple]) -> DataFrame:
    kind = dict(df.dtypes)["doc_id"]
    return df.sparkSession.createDataFrame(rows, f"_id {kind}, _first_tie bigint, _to int, _wraps boolean")


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8, ell: int = 2, bin_bits: int = 6
) -> DataFrame:
    """Fingerprint per document: ``doc_id, n_chars, fingerprint``."""
    docs = pick(df, id_col, text_col)
    return docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                       as_text(text_signature(F.col("text"), k, ell, bin_bits)).alias("fingerprint"))


def edit_probe(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8, ell: int = 2, bin_bits: int = 6
) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with their likeness.

    The edited text replaces the last ``floor(n_chars / 2)`` characters by the first as many of the next document. A
    single document is its own next. Repeated ids follow each other by a hash of their text.
    """
    docs = pick(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half),
                      F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    marked = with_next(docs).select(
        "doc_id", "_tie", "_range", "_halo", "_wraps", F.length("text").cast("long").alias("n_chars"),
        text_signature(F.col("text"), k, ell, bin_bits).alias("_own"),
        edited.alias("_edited"),
    )
    marked = marked.select(
        "*", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        F.when(~F.col("_halo"), text_signature(F.col("_edited"), k, ell, bin_bits)).alias("_new"),
    ).drop("_edited")
    marked = marked.withColumn("_next", F.lead("_own").over(in_range())).filter(~F.col("_halo"))
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_new")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_new")).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )
