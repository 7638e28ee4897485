"""Candidates that stay where they are made.

Recall deals users into slices. A slice's task holds all candidates of its users, so what needs only the candidates of one
user (the best of several recallers, ranges, ranks, the head of a list) follows there, some users at a time, and a row leaves the
task once, as part of the result. As rows of their own the candidates are thousands per user, far more than all that is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.functions.vectors import flat, id_array

FEW_SLICES = 12  # least slices where steps look up tables, which travel once to each
MORE = 3  # kind of the rows of further recallers; the first one's rows have lower kinds


@dataclass(frozen=True)
class Rows:
    """Rows of whole users, user after user and items ascending; ``owner`` is the place of a row's user in ``users``.

    A column of texts is a pair: codes, and the texts they stand for.
    """

    users: np.ndarray
    owner: np.ndarray
    columns: dict

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def __len__(self) -> int:
        return len(self.owner)

    def having(self, **columns) -> Rows:
        return replace(self, columns={**self.columns, **columns})

    def take(self, at: np.ndarray) -> Rows:
        """The rows at the given places; these keep the users in order."""
        cut = lambda c: (c[0][at], c[1]) if isinstance(c, tuple) else c[at]
        return Rows(self.users, self.owner[at], {name: cut(c) for name, c in self.columns.items()})

    def heads(self) -> np.ndarray:
        """The first row of each user that has rows."""
        return np.flatnonzero(np.append(True, self.owner[1:] != self.owner[:-1])) if len(self) else np.zeros(0, np.int64)

    def nth(self) -> np.ndarray:
        """How many rows of its user are before a row."""
        heads = self.heads()
        return np.arange(len(self)) - np.repeat(heads, np.diff(np.append(heads, len(self))))

    def sorted(self, keys: list[np.ndarray]) -> np.ndarray:
        """Places of the rows by user, then by the keys; equal ones stay in order."""
        heads = self.heads()
        order = np.empty(len(self), np.int64)
        for start, end in zip(heads, np.append(heads[1:], len(self))):
            key = keys[0][start:end]
            place = np.argsort(key, kind="stable")
            if len(keys) > 1 and (key[place[1:]] == key[place[:-1]]).any():
                place = np.lexsort([k[start:end] for k in reversed(keys)])
            order[start:end] = start + place
        return order

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        def array(f: pa.Field) -> pa.Array:
            value = self.users[self.owner] if f.name == "user_id" else self.columns[f.name]
            if isinstance(value, tuple):
                return pa.array(value[1], f.type).take(pa.array(value[0]))
            return pa.array(value, f.type)

        return pa.RecordBatch.from_arrays([array(f) for f in schema], schema=schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


@dataclass(frozen=True)
class Sliced:
    """Candidates by slices of users (the groups of ``rows`` by ``_u``): ``found`` makes those of a slice, ``steps`` follow.

    ``fields`` are the columns beside ``user_id`` with their types, ``fixed`` those with one value in all rows. ``tables`` are
    what steps look up: every slice gets these rows whole and makes them ready once.
    """

    rows: DataFrame
    slices: list[int]
    found: Callable[[pa.Table], Iterator[Rows]]
    fields: tuple[tuple[str, str], ...] = (("item_id", "long"), ("score", "double"))
    fixed: dict[str, str] = field(default_factory=dict)
    steps: tuple[Callable, ...] = ()
    tables: tuple[Callable[[pa.Table], object], ...] = ()

    def then(self, step: Callable[[Rows], Rows], **added: str) -> Sliced:
        """With a step over rows of whole users; ``added`` are its new columns and their types."""
        return replace(self, steps=(*self.steps, step), fields=(*self.fields, *added.items()))

    def knowing(self, lists: DataFrame, ready: Callable[[pa.Table], object], step: Callable[[Rows, object], Rows], **added: str) -> Sliced:
        """With a step that looks up the rows ``id, ids, values`` (a key and two lists), as ``ready`` holds them in a task."""
        no = len(self.tables)
        every = F.explode(F.array(*map(F.lit, self.slices))).alias("_u")
        rows = self.rows.unionByName(lists.select(
            every, F.lit(-1 - no).alias("_k"), F.col("id").alias("user_id"), F.lit(None).cast("string").alias("tag_type"),
            F.lit(None).cast("long").alias("tag_id"), F.col("ids").alias("movies"), F.col("values").alias("parts")))
        more = replace(self, rows=rows, tables=(*self.tables, ready))
        return replace(more, steps=(*self.steps, (step, no)), fields=(*self.fields, *added.items()))

    def only(self, *names: str, **fixed: str) -> Sliced:
        """Some of the columns, and columns with one value."""
        return replace(self, fields=tuple(f for f in self.fields if f[0] in names), fixed={**{k: v for k, v in self.fixed.items() if k in names}, **fixed})

    def frame(self) -> DataFrame:
        """The rows, one by one."""
        found, steps, tables = self.found, self.steps, self.tables
        fields = (("user_id", "long"), *self.fields)
        schema = pa.schema([(name, _TYPES[kind]) for name, kind in fields])

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches))
            kind = table["_k"].to_numpy()
            known = [ready(table.filter(pa.array(kind == -1 - no))) for no, ready in enumerate(tables)]
            table = table.filter(pa.array(kind >= 0)) if tables else table
            for rows in found(table):
                for step in steps:
                    rows = step[0](rows, known[step[1]]) if isinstance(step, tuple) else step(rows)
                if len(rows):
                    yield rows.batch(schema)

        # a partition is one slice, as slices are numbered by ``apart``
        out = self.rows.repartition(len(self.slices), "_u").groupBy("_u").applyInArrow(made, ", ".join(f"{name} {kind}" for name, kind in fields))
        return out.withColumns({name: F.lit(value) for name, value in self.fixed.items()}) if self.fixed else out


def as_rows(candidates: DataFrame | Sliced) -> DataFrame:
    return candidates.frame() if isinstance(candidates, Sliced) else candidates


def apart(spark: SparkSession, n: int) -> list[int]:
    """Numbers of n slices that a shuffle by them puts into n different partitions (of 64 n numbers nearly all find a place)."""
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    each = spark.range(64 * n).groupBy(at.alias("at")).agg(F.min("id").alias("id")).orderBy("at")
    found = [row["id"] for row in each.toLocalIterator()]  # n numbers
    return found + list(range(64 * n, 65 * n - len(found)))


def slice_of(slices: list[int]) -> Column:
    return F.element_at(F.array(*map(F.lit, slices)), (F.pmod(F.xxhash64("user_id"), F.lit(len(slices))) + 1).cast("int"))


class Facts:
    """A table of numbers by id, ``values`` as a matrix with a last row of zeros for unknown ids, and the lists ``ids``."""

    def __init__(self, table: pa.Table):
        key = id_array(table["user_id"])
        order = np.argsort(key)
        self.key, n = key[order], len(key)
        length, ids = flat(table["movies"])
        start = np.cumsum(length) - length
        self.length, self.start, self.ids = np.append(length[order], 0), np.append(start[order], 0), ids
        values = flat(table["parts"])[1].reshape(n, -1) if n else np.zeros((0, 1))
        self.values = np.concatenate([values[order], np.zeros((1, values.shape[1]))])

    def place(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, at, len(self.key))


def merged(first: Sliced, others: list[DataFrame]) -> Sliced:
    """Highest score per (user, item) of a recaller's slices and of other recallers' rows; on ties the earlier recaller.

    The other rows meet by user and travel to the slices as lists.
    """
    if first.steps:
        raise ValueError("candidates are merged before any other step")
    rows = first.rows
    for no, part in enumerate(others):
        lists = part.repartition("user_id").groupBy("user_id", "source").agg(
            F.collect_list(F.struct("item_id", F.col("score").cast("double").alias("score"))).alias("items"))
        rows = rows.unionByName(lists.select(
            slice_of(first.slices).alias("_u"), F.lit(MORE + no).alias("_k"), "user_id", F.col("source").alias("tag_type"),
            F.lit(None).cast("long").alias("tag_id"), F.col("items.item_id").alias("movies"), F.col("items.score").alias("parts")))
    found, name = first.found, first.fixed["source"]
    return replace(first, rows=rows, found=lambda table: _merged(table, found, name), fields=(*first.fields, ("source", "string")), fixed={})


def _merged(table: pa.Table, found: Callable, name: str) -> Iterator[Rows]:
    kind = table["_k"].to_numpy()
    more = table.filter(pa.array(kind >= MORE))
    table = table.filter(pa.array(kind < MORE))
    length, item = flat(more["movies"])
    owner, no = np.repeat(id_array(more["user_id"]), length), np.repeat(more["_k"].to_numpy() - MORE + 1, length)
    names, source = np.unique(np.array([name, *more["tag_type"].to_pylist()], dtype=object), return_inverse=True)
    own, source = source[0], np.repeat(source[1:], length)
    score = flat(more["parts"])[1]
    order = np.argsort(owner, kind="stable")
    owner, no, item, source, score = owner[order], no[order], item[order], source[order], score[order]

    def best(users: np.ndarray, parts: list[tuple]) -> Rows:
        u, item, score, no, source = (np.concatenate(p) for p in zip(*parts))
        high = np.where(np.isnan(score), -np.inf, -score)
        order = np.lexsort((-source, no, high, item, u))
        u, item = u[order], item[order]
        first = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (item[1:] != item[:-1])))
        return Rows(users, u[first], {"item_id": item[first], "score": score[order[first]], "source": (source[order[first]], list(names))})

    def of(mine: slice, users: np.ndarray) -> tuple:
        return np.searchsorted(users, owner[mine]), item[mine], score[mine], no[mine], source[mine]

    def alone(start: int, end: int) -> Iterator[Rows]:
        if start < end:
            users = np.unique(owner[start:end])
            yield best(users, [of(slice(start, end), users)])

    # users come in ascending order: those that only the other recallers know go between
    done = 0
    for rows in found(table):
        start, end = np.searchsorted(owner, rows.users[0], "left"), np.searchsorted(owner, rows.users[-1], "right")
        yield from alone(done, start)
        done = end
        if start == end:
            yield rows.having(source=(np.full(len(rows), own), list(names)))
            continue
        users = np.union1d(rows.users, owner[start:end])
        mine = (np.searchsorted(users, rows.users)[rows.owner], rows["item_id"], rows["score"], np.zeros(len(rows), np.int64), np.full(len(rows), own))
        yield best(users, [mine, of(slice(start, end), users)])
    yield from alone(done, len(owner))
