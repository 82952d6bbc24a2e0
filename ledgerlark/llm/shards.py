"""Sharding by bytes: contiguous shards of near-equal size.

Global byte-size prefix sums from per-partition totals, cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize


def byte_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id",
                text_col: str = "text", overhead: int = 8, row_col: str | None = None) -> DataFrame:
    """Put every row into one of ``shards`` contiguous shards of equal bytes.

    Rows are ordered by id (null first), then checksum.  A row's size is its
    text's UTF-8 bytes plus ``overhead`` (null text: overhead alone, null
    checksum).  A row goes to the shard in whose byte range its middle byte
    lies, so each shard misses its target by at most one row.

    The rows (id, size, checksum; no text) are range partitioned and written
    once with their partition number; totals per partition give each
    partition's offset, a window inside the partition the rest.  A repeated id
    is spread by checksum and row number, so no range holds a hot key.

    Returns rid (``row_col``, or a row number), doc_id, size, text_crc32, shard
    (0-based), slot (0-based, gapless in the shard) and row_index (global).  Repeated rows stay, one slot each; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()).alias("rid"))
    key = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc_nulls_first(), F.col("rid")]
    rows = materialize(rows.repartitionByRange(parts, *key)
                       .withColumn("part", F.spark_partition_id()), "shard-rows")

    totals = rows.groupBy("part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    totals = totals.select(                      # one row per partition
        "part",
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.sum("b").over(whole).alias("total"))
    inside = Window.partitionBy("part").orderBy(*key)
    placed = (rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("at", F.row_number().over(inside))
              .join(totals, "part")
              .withColumn("row_index", F.col("n0") + F.col("at") - 1)
              # twice the middle byte, to stay in whole numbers
              .withColumn("mid2", (2 * (F.col("b0") + F.col("upto")) - F.col("size")).cast("decimal(38,0)"))
              .withColumn("shard", F.least(
                  F.floor(F.col("mid2") * shards / (2 * F.col("total")).cast("decimal(20,0)")),
                  F.lit(shards - 1)).cast("int")))
    firsts = placed.groupBy("shard").agg(F.min("row_index").alias("first"))
    return placed.join(firsts, "shard").select(
        "rid", "doc_id", "size", "text_crc32", "shard",
        (F.col("row_index") - F.col("first")).cast("long").alias("slot"), "row_index")


def shard_documents(docs: DataFrame, shards: int = 24, **params) -> DataFrame:
    """``docs`` with the columns shard and slot (under free names)."""
    row = free_name(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "shard-docs")
    place = byte_shards(numbered, shards, row_col=row, **params).select(
        F.col("rid").alias(row), F.col("shard").alias(free_name(numbered, "shard")),
        F.col("slot").alias(free_name(numbered, "slot")))
    return numbered.join(place, row).drop(row)
