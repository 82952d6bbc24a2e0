"""Writing results.

Parquet tables take no row-level UPDATE/MERGE, so every change job produces a
new snapshot DataFrame; ``write_snapshot`` writes it to a fresh path and never
over the path being read.  Appends of time-based facts are partitioned by month
so later reports prune partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_facts(df: DataFrame, path: str, ts_col: str | None = None, run_id: str | None = None) -> None:
    """S3: append rows; time-based facts are partitioned by their month.

    Rows are dealt out by month before they are written, so a month gets as
    many files as its bytes need and not one from every task: ``rebalance`` lets
    Spark measure the months' shuffled bytes, split those above
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` and pack small ones.

    With ``run_id`` the rows of a run are a partition of their own below the
    month, which a repeated run replaces: appending the same rows again under
    the same id adds nothing, also after a run that failed halfway.
    """
    if ts_col is None and run_id is None:
        df.write.mode("append").parquet(path)
        return
    parts = []
    if ts_col is not None:
        parts.append("month_part")
        df = df.withColumn("month_part", F.date_format(F.col(ts_col), "yyyy-MM")).hint("rebalance", "month_part")
    if run_id is None:
        df.write.mode("append").partitionBy(*parts).parquet(path)
        return
    (df.withColumn("run_part", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*parts, "run_part").parquet(path))


def upsert_partitions(path: str, new_path: str, changes: DataFrame, keys: list[str], partition: str,
                      merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list:
    """S4, scoped: a new snapshot of a partitioned table in which only the
    partitions that a changed key falls into are read and written.

    ``path`` is partitioned by ``partition``, a column that ``changes`` has too
    and that a key's rows share (a function of the key, or a month).  The
    partitions that hold a changed row are found by one aggregate over the
    changes; ``merge(old, changes)`` (an ``upsert`` or ``apply_patch``) makes
    their new rows, which go to the same partitions under ``new_path`` with
    dynamic partition overwrite.  A reader takes each partition from
    ``new_path`` where it is there, else from ``path`` (``read_partitions``), so
    nothing else is copied and a rerun replaces its own output.

    Returns the values of the partitions written.
    """
    spark = changes.sparkSession
    touched = [r[0] for r in changes.select(partition).distinct().collect()]     # partitions of the table, not rows
    kinds = spark.read.parquet(path).schema
    old = spark.read.parquet(path).where(F.col(partition).isin(touched) if touched else F.lit(False))
    rows = merge(old, changes).select(*kinds.names)
    rows.hint("rebalance", partition).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(new_path)
    return touched


def read_partitions(spark: SparkSession, path: str, new_path: str, partition: str) -> DataFrame:
    """The table after ``upsert_partitions``: replaced partitions from ``new_path``, all others from ``path``."""
    new, old = spark.read.parquet(new_path), spark.read.parquet(path)
    replaced = [r[0] for r in new.select(partition).distinct().collect()]
    return old.where(~F.col(partition).isin(replaced) if replaced else F.lit(True)).unionByName(new)


def write_snapshot(df: DataFrame, path: str) -> str:
    """Write a full new snapshot of a changed table to ``path``.

    ``path`` must be new: an existing one is an error, never overwritten.
    Returns the path for the caller to switch to.
    """
    df.write.mode("errorifexists").parquet(path)
    return path


def as_json(df: DataFrame, nested: dict[str, list[str]] | None = None,
            keep: list[str] | None = None) -> DataFrame:
    """One JSON text per row; ``nested`` groups columns into objects."""
    nested = nested or {}
    inner = {c for cols in nested.values() for c in cols}
    parts: list[Column] = [F.col(c) for c in df.columns if c not in inner]
    parts += [F.struct(*[F.col(c) for c in cols]).alias(name) for name, cols in nested.items()]
    out = [F.to_json(F.struct(*parts)).alias("json")]
    out += [F.col(c) for c in (keep or [])]
    return df.select(*out)
