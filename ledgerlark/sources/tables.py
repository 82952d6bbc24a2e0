"""Reading domain tables.

Two ways in: ``load_tables`` builds them from the driver's parquet files
through the adapters; ``read_domain_tables`` reads domain tables already stored
as parquet (one folder per table) with the declared schema, so no inference
and full predicate / column pushdown.  A relational database is read the same
way with ``spark.read.jdbc(url, table, column=<id>, lowerBound, upperBound,
numPartitions)`` so the scan is split by key range across executors; that path
is not exercised here because no database is available.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .adapters import ADAPTERS, adapter_frame
from .schemas import COLUMNS, schema


class Tables:
    """Lazy access to domain tables: ``t.businesses``, ``t["payments"]``."""

    def __init__(self, spark: SparkSession, build):
        self._spark = spark
        self._build = build
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self._build(name)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    @property
    def spark(self) -> SparkSession:
        return self._spark


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Domain tables built from the driver tables under ``sf_dir``."""
    def build(name: str) -> DataFrame:
        if name not in ADAPTERS:
            raise KeyError(f"no adapter for {name}")
        return adapter_frame(spark, sf_dir, name)
    return Tables(spark, build)


def read_domain_tables(spark: SparkSession, root: str) -> Tables:
    """Domain tables stored as ``{root}/{table}/`` parquet with declared schemas."""
    def build(name: str) -> DataFrame:
        if name not in COLUMNS:
            raise KeyError(f"unknown domain table {name}")
        return spark.read.schema(schema(name)).parquet(f"{root}/{name}")
    return Tables(spark, build)
