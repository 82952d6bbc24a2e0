"""Storage layout for co-located joins.

Most reports join businesses, subscriptions, payments, referrals and earnings
on the business id, and aggregate per business.  Writing those tables
bucketed (and sorted) by that id with the same bucket count lets Spark join
and aggregate them without shuffling either side: the bucket spec is kept in
the catalog and the scans report a matching hash partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Domain tables and the column holding the business id they join on.
BUSINESS_KEY = {
    "businesses": "id",
    "subscriptions": "business_id",
    "payments": "business_id",
    "reviews": "business_id",
    "referral_earnings": "business_id",
    "qr_codes": "business_id",
    "bank_details": "business_id",
}


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int,
                   database: str | None = None) -> str:
    """Save ``df`` as a catalog table bucketed and sorted by ``key``.

    Use one bucket count for all tables that join with each other; size it so
    one bucket of the largest table is a few hundred MB.
    """
    name = f"{database}.{table}" if database else table
    (df.write.mode("overwrite").format("parquet")
       .bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    return name


def write_business_tables(tables, names: list[str], buckets: int, prefix: str = "") -> dict[str, str]:
    """Bucket the named domain tables by their business id (``BUSINESS_KEY``)."""
    out = {}
    for n in names:
        out[n] = write_bucketed(tables[n], f"{prefix}{n}", BUSINESS_KEY[n], buckets)
    return out


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
