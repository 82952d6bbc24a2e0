"""Literal tables and folders that the business tests share."""

import datetime as dt

from ledgerlark.sources.adapters import EXTRA_TYPES
from ledgerlark.sources.schemas import COLUMNS, schema, spark_type

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def mk(spark, table: str, rows: list[dict]):
    """A small literal domain table; unspecified columns are NULL."""
    from pyspark.sql import types as T
    if table in COLUMNS:
        sch = schema(table)
    else:
        sch = T.StructType([T.StructField(n, spark_type(t)) for n, t in EXTRA_TYPES[table].items()])
    data = [tuple(r.get(f.name) for f in sch.fields) for r in rows]
    return spark.createDataFrame(data, sch)
