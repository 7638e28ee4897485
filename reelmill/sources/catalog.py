"""The set of logical tables an operator reads."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from reelmill.schemas import SCHEMAS
from reelmill.sources import fixtures, scaled

# Derived by a window over a join and read by most operators, often several times in one
# job; in production it is a stored table.
KEPT = {"rating"}

_FROM = re.compile(r"\b(FROM|JOIN)\s+([a-z_]+)\b(?!\s*\()", re.IGNORECASE)


class Catalog:
    """Named tables, each built on first use and then shared by all operators of a job."""

    def __init__(self, spark: SparkSession, load: Callable[[str], DataFrame], as_of: datetime, base_folder: str = ""):
        self.spark = spark
        self.as_of = as_of
        self.base_folder = base_folder
        self._load = load
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._load(name)
        return self._tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def replace(self, **tables: DataFrame) -> "Catalog":
        """The same catalog with some tables exchanged, e.g. for the ids touched by a batch."""
        other = Catalog(self.spark, lambda name: self.table(name), self.as_of, self.base_folder)
        other._tables.update(tables)
        return other


def from_parquet(spark: SparkSession, root: str, as_of: datetime) -> Catalog:
    """Production tables, one Parquet folder each, read with their declared schema."""

    def load(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")

    return Catalog(spark, load, as_of, root)


def from_jdbc(
    spark: SparkSession,
    url: str,
    as_of: datetime,
    key_ranges: dict[str, tuple[str, int, int]],
    readers: int = 64,
    **options: str,
) -> Catalog:
    """Tables of a relational database, read in parallel ranges of an integer key.

    ``key_ranges`` names, per table, the key column and its lowest and highest value.
    """

    def load(name: str) -> DataFrame:
        column, low, high = key_ranges[name]
        wanted = StructType.fromDDL(SCHEMAS[name])
        raw = (
            spark.read.format("jdbc")
            .options(url=url, dbtable=name, partitionColumn=column, lowerBound=low, upperBound=high,
                     numPartitions=readers, **options)
            .load()
        )
        return raw.select([raw[f.name].cast(f.dataType).alias(f.name) for f in wanted.fields])

    return Catalog(spark, load, as_of)


def from_fixture(spark: SparkSession, sf_dir: str, as_of: datetime = fixtures.AS_OF) -> Catalog:
    """The logical tables over the driver's Parquet files (see ``fixtures``)."""
    base = {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in fixtures.BASE_TABLES}

    def load(name: str) -> DataFrame:
        if name in base:
            return spark.read.parquet(base[name])
        if name in scaled.VIEWS:
            build, needs = scaled.VIEWS[name]
            built = build(*[catalog.table(n) for n in needs])
            return built.persist() if name in KEPT else built
        sources: dict[str, DataFrame] = {}

        def point(match: re.Match) -> str:
            ref = match.group(2)
            if ref in base:
                sources[ref] = catalog.table(ref)
            elif ref in fixtures.VIEWS:
                sources[ref] = catalog.table(ref.removeprefix("fx_"))
            else:
                return match.group(0)
            return f"{match.group(1)} {{{ref}}}"

        text = fixtures.view_text(f"fx_{name}", "spark").replace("{", "{{").replace("}", "}}")
        text = _FROM.sub(point, text)
        built = spark.sql(text, **sources)
        return built.persist() if name in KEPT else built

    catalog = Catalog(spark, load, as_of, sf_dir)
    return catalog
