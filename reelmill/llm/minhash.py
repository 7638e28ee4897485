"""Near duplicates by an inverted join of MinHash signature coordinates.

A document's set holds its distinct shingles of ``size`` words; a shorter text is one shingle, a text without words has the
empty set and no links. Equal sets form a class, whatever the ids of their rows; classes are the nodes of all that follows.

1. Every class has a signature of 64 coordinates. Two classes of Jaccard similarity 0.8 agree in 51 of them on average and
   in fewer than ``MATCHES`` = 33 with a probability below 1e-7.
2. Classes are posted under coordinate-value pairs, two neighbouring coordinates at a time: of the 32 couples one must
   agree in both if 33 coordinates agree (the pigeonhole principle stands in for a prefix of rare values), and texts that only
   share a passage seldom meet. Lists of one class are skipped.
3. The hub of a list is its member of the lowest draw, so the lists of one group name few hubs; members are paired with
   hubs. Pairs of fitting sizes that agree in 33 coordinates are confirmed on the full sets; links make components.
4. Lists that still hold several components are compared block by block, without the pairs inside a component (skip
   merging); a pair counts only in the first list both share. Only members with a likely partner go on, with their sets:
   pairs are confirmed in the task, which keeps a link only if it joins two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import free_name, give_back, let, pick, short_batches, words
from reelmill.llm.components import components
from reelmill.operators.ordering import spread
from reelmill.session import broadcast_if_small, cut_lineage

GAPS = "[\\x20\\x09-\\x0D]+"
COORDINATES = 64
MATCHES = 33
COUPLES = COORDINATES // 2  # 33 equal coordinates are more than one for each
BLOCK = 2048  # classes that meet others in one group of rows
SHINGLES = 200_000  # about as many shingles form a block of sets
SALTS = 8  # parts of a group of equal sets when its rows learn their component

MEMBER = "token long, node long, component_id long, couple int, n long, tokens binary"

_SEED = np.random.default_rng(20240229)
_MUL = _SEED.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def shingles(text: Column, size: int) -> Column:
    """Distinct 64-bit hashes of a text's shingles; the first of them is replaced by that of all words if there are few."""
    hashed = lambda ws: F.transform(ws, lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))
    return F.array_distinct(let(let(words(text, GAPS), hashed), lambda h: (
        F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .when(F.size(h) < size, F.array(F.xxhash64(h, F.lit(size))))
        .otherwise(runs(h)))))


def set_id(found: Column) -> Column:
    """128 bits that stand for a set of shingles."""
    return let(F.sort_array(found), lambda s: F.struct(F.xxhash64(s).alias("a"), F.xxhash64(s, F.lit(1)).alias("b")))


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Coordinate values (bytes of 64 uint32) and one byte of each (sketch) of the sets; an empty set has none."""
    give_back()
    for batch in batches:
        sets = batch["shingles"].to_list()
        out = np.zeros((len(sets), COORDINATES), np.uint32)
        filled = [i for i, s in enumerate(sets) if len(s)]
        for part in _portions(filled, sets):
            flat = np.concatenate([sets[i] for i in part]).view(np.uint64)
            flat ^= flat >> np.uint64(29)
            starts = np.cumsum([0] + [len(sets[i]) for i in part[:-1]])
            mixed = np.empty_like(flat)
            for c in range(COORDINATES):
                np.multiply(flat, _MUL[c], out=mixed)
                mixed += _ADD[c]
                out[part, c] = np.minimum.reduceat(mixed, starts) >> np.uint64(32)
        sketch = ((out * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)
        yield batch.drop(columns="shingles").assign(tokens=[r.tobytes() for r in out], sketch=[r.tobytes() for r in sketch])


def _portions(filled: list[int], sets: list) -> Iterator[list[int]]:
    """Runs of sets that fit the processor's cache together."""
    part, n = [], 0
    for i in filled:
        part.append(i)
        n += len(sets[i])
        if n > 30_000:
            yield part
            part, n = [], 0
    if part:
        yield part


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per couple of coordinates: its place and a hash of place and values. A collision only lengthens a list."""
    couple = np.arange(COUPLES, dtype=np.uint64)
    for batch in batches:
        if not len(batch):
            continue
        token = np.frombuffer(b"".join(batch["tokens"]), np.uint64).reshape(-1, COUPLES) ^ (couple + np.uint64(1)) * _MUL[0]
        for shift, by in ((32, 1), (29, 2), (32, 3)):
            token = (token ^ (token >> np.uint64(shift))) * _MUL[by]
        yield pd.DataFrame({"node": np.repeat(batch["node"].to_numpy(), COUPLES), "token": token.view(np.int64).ravel(),
                            "couple": np.tile(couple.astype(np.int32), len(batch))})


def _sizes_fit(n, m):
    """Whether sets of these sizes can have a similarity of 0.8."""
    return 100 * np.minimum(n, m) >= 80 * np.maximum(n, m)


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of fitting sizes whose sketches agree in enough coordinates."""
    for batch in batches:
        if not len(batch):
            continue
        batch = batch[_sizes_fit(batch["n_u"].to_numpy(), batch["n_v"].to_numpy())]
        a, b = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, COORDINATES) for c in ("sketch_u", "sketch_v"))
        yield batch.loc[(a == b).sum(axis=1) >= MATCHES, ["u", "v"]]


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows that come sorted by their keys, in whole groups, and where each group starts.

    A group is bounded; it is known to be whole when the next one starts.
    """
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        at = batch[keys].to_numpy()
        starts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
        last = int(starts[-1]) if len(starts) else 0
        rest = batch.iloc[last:].reset_index(drop=True)
        if last:
            yield batch.iloc[:last], np.concatenate([[0], starts[:-1]])
    if rest is not None:
        yield rest, np.array([0])


class _Members:
    """Members of lists: components, sizes and signatures."""

    def __init__(self, rows: pd.DataFrame):
        self.comps, self.sizes, self.couple = (rows[c].to_numpy() for c in ("component_id", "n", "couple"))
        values = np.frombuffer(b"".join(rows["tokens"]), np.uint32).reshape(-1, COORDINATES)
        self.sketch = ((values * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)
        self.couples = np.ascontiguousarray(values).view(np.uint64)

    def likely(self, one: np.ndarray, first: np.ndarray, count: np.ndarray, at_once: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of each row in ``one`` with the ``count`` rows from ``first`` on that may be links across components and agree in
        no earlier couple."""
        done = np.cumsum(count)
        for part in np.split(np.arange(len(one)), np.searchsorted(done, np.arange(at_once, int(done[-1]) if len(done) else 0, at_once))):
            if not len(part):
                continue
            n = count[part]
            i = np.repeat(one[part], n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[part], n)
            good = (self.comps[i] != self.comps[j]) & _sizes_fit(self.sizes[i], self.sizes[j])
            i, j = i[good], j[good]
            good = (self.sketch[i] == self.sketch[j]).sum(axis=1, dtype=np.uint8) >= MATCHES
            i, j = i[good], j[good]
            before = np.arange(COUPLES)[None, :] < self.couple[i][:, None]
            new = ~((self.couples[i] == self.couples[j]) & before).any(axis=1)
            yield i[new], j[new]


def _partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each group (token, block, part) with a likely partner in another component; those that ask come last."""
    for rows, starts in _whole_groups(batches, ["token", "block", "part"]):
        asks = rows["asks"].to_numpy()
        build = np.add.reduceat(~asks, starts, dtype=np.int64)
        group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(rows)]))
        one = np.flatnonzero(asks)
        found = np.zeros(len(rows), bool)
        for i, j in _Members(rows).likely(one, starts[group[one]], build[group[one]]):
            found[i] = found[j] = True
        yield rows.loc[found].drop(columns=["block", "part", "asks"])


def _shared_bits(sets: list[np.ndarray]) -> np.ndarray:
    """Sets as rows of bits over the elements that several of them hold."""
    which, at = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(at) > 1
    place = np.cumsum(often) - 1
    bits = np.zeros((len(sets), max(1, -(-int(often.sum()) // 64)) * 8), np.uint8)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kept = often[at]
    row, column = row[kept], place[at[kept]]
    np.bitwise_or.at(bits, (row, column >> 3), (1 << (column & 7)).astype(np.uint8))
    return bits.view(np.uint64)


def _joining(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Confirmed links between the two blocks of each group (token, low, high) that join components, fewer than it has rows."""
    for groups, starts in _whole_groups(batches, ["token", "low", "high"]):
        for start, end in zip(starts, [*starts[1:], len(groups)]):
            yield _links_of(groups.iloc[start:end].sort_values("block", ignore_index=True))


def _links_of(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one group, those of the low block first."""
    sizes, comps, nodes = (rows[c].to_numpy() for c in ("n", "component_id", "node"))
    low = int((rows["block"] == rows["low"]).sum())
    first, count = (0, len(rows)) if low == len(rows) else (low, len(rows) - low)
    parent = {c: c for c in comps.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    bits, us, vs = None, [], []
    for i, j in _Members(rows).likely(np.arange(low), np.full(low, first), np.full(low, count)):
        if not len(i):
            continue
        if bits is None:
            bits = _shared_bits(rows["s"].to_list())
        for part in np.array_split(np.arange(len(i)), max(1, len(i) * bits.shape[1] // 2_000_000)):
            a, b = i[part], j[part]
            both = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64)
            linked = 100 * both >= 80 * (sizes[a] + sizes[b] - both)
            for x, y in zip(a[linked].tolist(), b[linked].tolist()):
                p, q = root(int(comps[x])), root(int(comps[y]))
                if p != q:
                    parent[p] = q
                    us.append(nodes[x])
                    vs.append(nodes[y])
    return pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})


def _posted(signed: DataFrame) -> DataFrame:
    """``node, token, couple, hub``: the lists of several classes and the hub of each."""
    tokens = signed.select("node", "tokens").mapInPandas(_tokens, "node long, token long, couple int")
    drawn = F.struct(F.xxhash64("node").alias("draw"), F.col("node"))
    hubs = tokens.groupBy("token").agg(F.min(drawn).alias("hub"), F.count("*").alias("n")).filter("n > 1")
    hubs = cut_lineage(hubs.select("token", F.col("hub.node").alias("hub")))  # both sides of the join can then be split
    return tokens.join(hubs, "token")


def _full_sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame, size: int, known: DataFrame | None = None) -> DataFrame:
    """``node, s``: the full sets of classes, read from the text of one of their rows again, beside those that are known."""
    wanted = nodes.distinct()
    if known is not None:
        wanted = wanted.join(known, "node", "left_anti")
    speakers = wanted.join(classes, "node").select(
        "node", "speaker.text_hash", "speaker.no_id", F.coalesce("speaker.doc_id", F.lit(0)).alias("id"))
    speakers = cut_lineage(speakers)
    rows = docs.withColumn("no_id", F.col("doc_id").isNull()).withColumn("id", F.coalesce("doc_id", F.lit(0)))
    found = rows.join(broadcast_if_small(speakers, 500_000), ["text_hash", "no_id", "id"])
    sets = cut_lineage(found.select("node", shingles(F.col("text"), size).alias("s")).dropDuplicates(["node"]))
    return sets if known is None else known.unionByName(sets)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets have a Jaccard similarity of 0.8 or more, in whole numbers."""
    met = (
        pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("su")), "u")
        .join(sets.select(F.col("node").alias("v"), F.col("s").alias("sv")), "v")
        .select("u", "v", F.size("su").alias("nu"), F.size("sv").alias("nv"), F.size(F.array_intersect("su", "sv")).alias("both"))
    )
    return met.filter("100 * both >= 80 * (nu + nv - both)").select("u", "v")


def _open_members(posted: DataFrame, signed: DataFrame, comps: DataFrame) -> DataFrame:
    """The members of lists of several components that have a likely partner in another one: ``MEMBER``."""
    known = posted.join(comps.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    known = cut_lineage(known.select("node", "token", "couple", F.coalesce("component_id", "node").alias("component_id")))
    sizes = known.groupBy("token", "component_id").agg(F.count("*").alias("n"))
    lists = sizes.groupBy("token").agg(F.max(F.struct("n", "component_id")).alias("top"), F.sum("n").alias("members"), F.count("*").alias("k"))
    lists = cut_lineage(lists.filter("k > 1").select(
        "token", F.col("top.component_id").alias("major"),
        F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("members") - F.col("top.n")) / BLOCK).cast("int").alias("parts")))
    here = known.join(lists, "token").join(signed.select("node", "n", "tokens"), "node")
    member = ["token", "node", "component_id", "couple", "n", "tokens"]
    own_block, own_part = F.pmod(F.xxhash64("node"), "blocks").cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), "parts").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = here.filter("component_id != major").select(*member, every("blocks").alias("block"), own_part.alias("part"), F.lit(True).alias("asks"))
    build = here.select(*member, own_block.alias("block"), every("parts").alias("part"), F.lit(False).alias("asks"))
    keys = ["token", "block", "part"]
    dealt = spread(asks.unionByName(build), *keys).sortWithinPartitions(*keys, "asks")
    return dealt.mapInPandas(_partners, MEMBER).dropDuplicates(["token", "node"])


def _open_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links across components among the members of each list."""
    sizes = members.groupBy("token").agg(F.ceil(F.sum("n") / SHINGLES).cast("int").alias("blocks"))
    blocked = members.join(sizes, "token").withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = blocked.withColumn("other", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    keys = ["token", "low", "high"]
    dealt = spread(paired.drop("blocks", "other").join(sets, "node"), *keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(_joining, "u long, v long").distinct()


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    short_batches(df.sparkSession)
    docs = pick(df, id_col, text_col)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def _placed(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, n_copies, first`` of every row; ``first`` is the row that stands for its component."""
    told = docs.select("doc_id", "text_hash", shingles(F.col("text"), size).alias("shingles")).select(
        "doc_id", "text_hash", F.size("shingles").cast("long").alias("n"), set_id(F.col("shingles")).alias("set_id"), "shingles")
    told = cut_lineage(told.select("doc_id", "text_hash", "n", "set_id.a", "set_id.b", "shingles").mapInPandas(
        _signatures, "doc_id long, text_hash long, n long, a long, b long, tokens binary, sketch binary"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"))
    classes = told.filter("n > 0").groupBy("a", "b").agg(
        F.min(row).alias("speaker"), F.count("*").alias("n_copies"), *[F.first(c).alias(c) for c in ("n", "tokens", "sketch")])
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()))  # numbers are fixed by the checkpoint
    signed = classes.select("node", "n", "tokens", "sketch")
    posted = cut_lineage(_posted(signed))
    u, v = (signed.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "uv")
    pairs = posted.filter("node != hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    likely = cut_lineage(pairs.join(u, "u").join(v, "v").mapInPandas(_alike, "u long, v long"))
    sets = _full_sets(likely.select(F.col("u").alias("node")).union(likely.select("v")), docs, classes, size)
    links = cut_lineage(_confirmed(likely, sets))
    members = cut_lineage(_open_members(posted, signed, components(links)))
    sets = _full_sets(members.select("node"), docs, classes, size, sets)
    more = cut_lineage(_open_links(members, sets))
    between = cut_lineage(components(links.unionByName(more)))
    firsts = between.join(classes.select("node", "speaker"), "node").groupBy("component_id").agg(F.min("speaker").alias("first"))
    linked = between.join(firsts, "component_id").select("node", "first")
    found = classes.join(linked, "node", "left").filter("first IS NOT NULL OR n_copies > 1").select(
        "a", "b", "n_copies", F.coalesce("first", "speaker").alias("first"))
    # many rows may share one set: they are spread over salts where the join shuffles them
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = told.select("doc_id", "text_hash", "n", "a", "b", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    placed = rows.filter("n > 0").join(salted, ["a", "b", "salt"], "left").unionByName(
        rows.filter("n = 0").withColumn("n_copies", F.lit(None).cast("long")).withColumn("first", F.lit(None).cast(dict(found.dtypes)["first"])))
    return placed.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
                         F.coalesce("first", row).alias("first"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, n_copies`` of every row.

    ``component_id``: the smallest id of the rows that can be reached; ``kept``: whether it is the row's own. ``n_copies``:
    rows with the same set. Ids are integers. Rows are linked by their texts, so rows of one id with different texts may be in
    different components, and a row with a null id is linked as others are; its component is null only if no row there
    has an id. Empty texts are alone. Empty input gives no rows.
    """
    placed = _placed(_rows(df, id_col, text_col), size)
    return placed.select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"),
                         F.col("doc_id").eqNullSafe(F.col("first.doc_id")).alias("kept"), "n_copies")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """One row for every component, all columns: that of the smallest id (null ids last), then of a hash of the text.

    Of rows that repeat id and text one stays, also if the text is empty; any of them if other columns differ. Rows without words are no copies of one another.
    """
    placed = _placed(_rows(df, id_col, text_col), size)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"))
    counted = placed.groupBy("doc_id", "text_hash").agg(F.max(row != F.col("first")).alias("gone"), F.count("*").alias("n"))
    name = free_name(df)
    key = F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).alias(name)
    counted = cut_lineage(counted.filter("gone OR n > 1").select(key, "gone"))
    keyed = df.withColumn(name, F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h")))
    gone, twice = counted.filter("gone").drop("gone"), counted.filter("NOT gone").drop("gone")
    left = keyed.join(broadcast_if_small(gone), name, "left_anti")
    if twice.isEmpty():
        return left.drop(name)
    single = left.join(broadcast_if_small(twice), name, "left_anti")
    many = left.join(broadcast_if_small(twice), name, "left_semi").dropDuplicates([name])
    return single.unionByName(many).drop(name)
