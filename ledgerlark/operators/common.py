"""Shared building blocks: latest-per-key, top-n-per-key, keyed patch, upsert,
month calendar, exact ranking within a key.

All of these are partial-aggregate or shuffle-on-key plans.  None collects a
group into one task unless the name says so (``top_n_by_key`` relies on the
optimizer's pre-shuffle group limit, so even a hot key ships at most n rows
per map task).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types


# --------------------------------------------------------------------------- order
class Desc:
    """Descending sort key; ``nulls_first`` follows PostgreSQL's DESC default."""

    def __init__(self, col: str, nulls_first: bool = True):
        self.col, self.nulls_first = col, nulls_first


def _max_struct_components(order: Sequence[Desc]) -> list[Column]:
    comps = []
    for i, o in enumerate(order):
        c = F.col(o.col)
        flag = c.isNull() if o.nulls_first else c.isNotNull()
        comps += [flag.alias(f"__n{i}"), c.alias(f"__v{i}")]
    return comps


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Desc],
                  cols: Sequence[str]) -> DataFrame:
    """One row per key: the first row under ``ORDER BY order`` (all DESC).

    Built as ``max(struct(order..., payload...))`` grouped by key: a hash
    aggregate with a map-side partial step, so a key holding a third of all
    rows is reduced on every map task before the shuffle.  NULL placement is
    encoded in a flag, so DESC NULLS FIRST (the PostgreSQL default the
    reference relies on) is kept; ``max_by`` would skip NULL order keys.
    Add a unique column (the id) last in ``order`` to break ties.
    """
    payload = [F.col(c).alias(c) for c in cols if c not in keys]
    packed = F.struct(*_max_struct_components(order), *payload)
    out = df.groupBy(*keys).agg(F.max(packed).alias("__m"))
    return out.select(*keys, *[F.col(f"__m.{c}").alias(c) for c in cols if c not in keys])


def earliest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    cols: Sequence[str]) -> DataFrame:
    """One row per key with the smallest ``order`` (ASC, NULLs last), as ``min(struct)``."""
    comps = []
    for i, o in enumerate(order):
        comps += [F.col(o).isNull().alias(f"__n{i}"), F.col(o).alias(f"__v{i}")]
    payload = [F.col(c).alias(c) for c in cols if c not in keys]
    out = df.groupBy(*keys).agg(F.min(F.struct(*comps, *payload)).alias("__m"))
    return out.select(*keys, *[F.col(f"__m.{c}").alias(c) for c in cols if c not in keys])


def top_n_by_key(df: DataFrame, key: str, order: Sequence[Column], n: int,
                 rank_col: str | None = None) -> DataFrame:
    """At most ``n`` rows per key under ``order`` (``row_number() <= n``).

    Catalyst plans a partial ``WindowGroupLimit`` below the shuffle, so a hot
    key sends at most n rows per map task to the final window.
    """
    w = Window.partitionBy(key).orderBy(*order)
    rn = rank_col or "__rn"
    out = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= n)
    return out if rank_col else out.drop(rn)


# --------------------------------------------------------------------------- changes
def unique_patch(patch: DataFrame, keys: Sequence[str], order_col,
                 cols: Sequence[str]) -> DataFrame:
    """Make a change set unique per key: the last change by ``order_col`` (a
    column name or a list of them, later ones breaking ties) wins."""
    if order_col is None:
        return patch.select(*keys, *cols).dropDuplicates(list(keys))
    names = [order_col] if isinstance(order_col, str) else list(order_col)
    tie = [Desc(c, nulls_first=False) for c in names]
    return latest_by_key(patch, keys, tie, [*keys, *cols])


def apply_patch(target: DataFrame, patch: DataFrame, keys: Sequence[str],
                sets: dict[str, Column | str], order_col: str | None = None,
                patch_cols: Sequence[str] | None = None,
                flag: str | None = None) -> DataFrame:
    """Keyed UPDATE as a new snapshot.

    ``sets`` maps a target column to an expression over patch columns (use
    ``F.col("p.<name>")``) or a patch column name.  Rows without a matching
    patch keep every value.  The patch is made unique per key first (latest by
    ``order_col``), so the left join cannot multiply target rows.  ``flag``
    adds a boolean column telling which rows were matched.
    """
    pcols = list(patch_cols) if patch_cols is not None else [
        c for c in patch.columns if c not in keys]
    p = unique_patch(patch, keys, order_col, pcols)
    p = p.select(*[F.col(k).alias(f"__k_{k}") for k in keys],
                 *[F.col(c).alias(f"__p_{c}") for c in pcols], F.lit(True).alias("__hit"))
    cond = None
    for k in keys:
        c = F.col(k) == F.col(f"__k_{k}")
        cond = c if cond is None else cond & c
    j = target.join(p, cond, "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    out_cols = []
    for c in target.columns:
        if c in sets:
            e = sets[c]
            e = F.col(f"__p_{e}") if isinstance(e, str) else e
            out_cols.append(F.when(hit, e).otherwise(F.col(c)).alias(c))
        else:
            out_cols.append(F.col(c))
    if flag:
        out_cols.append(hit.alias(flag))
    return j.select(*out_cols)


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str],
           sets: dict[str, Column], inserts: dict[str, Column],
           order_col: str | None = None) -> DataFrame:
    """INSERT .. ON CONFLICT (keys) DO UPDATE as a new snapshot.

    Changes are made unique per key (latest by ``order_col``); then one full
    outer join on the key: matched rows take ``sets`` (expressions may use
    ``T(col)`` for the old value and ``P(col)`` for the change), unmatched
    changes become new rows built from ``inserts``.  Both sides shuffle on the
    key once; nothing is broadcast without Spark's own size check.
    """
    ccols = [c for c in changes.columns if c not in keys]
    ch = unique_patch(changes, keys, order_col, ccols)
    t = target.select(*[F.col(c).alias(f"__t_{c}") for c in target.columns],
                      F.lit(True).alias("__in_t"))
    p = ch.select(*[F.col(c).alias(f"__p_{c}") for c in ch.columns], F.lit(True).alias("__in_p"))
    cond = None
    for k in keys:
        c = F.col(f"__t_{k}") == F.col(f"__p_{k}")
        cond = c if cond is None else cond & c
    j = t.join(p, cond, "full_outer")
    in_t, in_p = F.col("__in_t").isNotNull(), F.col("__in_p").isNotNull()
    out = []
    for c in target.columns:
        if c in keys:
            e = F.coalesce(F.col(f"__t_{c}"), F.col(f"__p_{c}"))
        else:
            old = F.col(f"__t_{c}")
            upd = sets.get(c, old)
            new = inserts.get(c, F.lit(None).cast(target.schema[c].dataType))
            e = F.when(in_t & in_p, upd).when(in_t, old).otherwise(new)
        out.append(e.cast(target.schema[c].dataType).alias(c))
    return j.select(*out)


def T(c: str) -> Column:
    """Old (target) value inside ``upsert`` expressions."""
    return F.col(f"__t_{c}")


def P(c: str) -> Column:
    """Change value inside ``upsert`` expressions."""
    return F.col(f"__p_{c}")


def above_max(table: DataFrame, offset: Column, col: str = "id") -> Column:
    """A new id: ``offset`` (positive, unique among the new rows) above the
    largest id in ``table``, by a scalar subquery."""
    return F.coalesce(table.agg(F.max(col)).scalar(), F.lit(0)) + offset


# --------------------------------------------------------------------------- calendar
def month_calendar(spark: SparkSession, as_of, months: int, col: str = "month") -> DataFrame:
    """The ``months`` month starts ending with the month of ``as_of``.

    Replaces the recursive CTE: one ``sequence`` exploded; its size is the
    ``months`` argument, independent of data volume.
    """
    end = F.date_trunc("month", F.to_timestamp(F.lit(str(as_of))))
    start = F.date_trunc("month", F.add_months(end, -(months - 1)).cast("timestamp"))
    return spark.range(1).select(
        F.explode(F.sequence(start, end, F.expr("INTERVAL 1 MONTH"))).alias(col))


def sum0(c: Column) -> Column:
    """COALESCE(SUM(c), 0) keeping the decimal type."""
    return F.coalesce(F.sum(c), F.lit(0).cast("decimal(18,2)"))


# --------------------------------------------------------------------------- ranks
def order_slice(df: DataFrame, col: str, width: int) -> Column:
    """Slices of ``width`` seconds (a time column) or units (a number) of an
    order column: contiguous, in order, NULL for NULL."""
    kind = df.schema[col].dataType
    if isinstance(kind, (types.TimestampType, types.TimestampNTZType, types.DateType)):
        return F.floor(F.unix_timestamp(F.col(col).cast("timestamp")) / width)
    if isinstance(kind, types.NumericType):
        return F.floor(F.col(col) / width)
    raise TypeError(f"{col}: the first order column must be a time or a number")


def equal_slices(df: DataFrame, key: str, col: str, slices: int, least: int, out: str) -> DataFrame:
    """``df`` with a slice number ``out`` for the rows of keys with more than
    ``least`` rows: ``slices`` contiguous slices of about equal row counts along
    ``col``, whatever its distribution; 0 for all other rows.

    The bounds are ``approx_percentile`` sketches, merged map-side, so a hot
    key's rows never meet; only the balance of the slices is approximate.  Rows
    of one value share a slice.
    """
    v = F.col(col)
    if isinstance(df.schema[col].dataType, (types.TimestampType, types.TimestampNTZType, types.DateType)):
        v = F.unix_micros(v.cast("timestamp"))
    cuts = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    bounds = df.groupBy(F.col(key).alias("__hot")).agg(
        F.approx_percentile(v, cuts, F.lit(20 * slices)).alias("__bounds"), F.count(F.lit(1)).alias("__rows"))
    bounds = bounds.where(F.col("__rows") > least).drop("__rows")
    below = F.size(F.filter("__bounds", lambda b: b < v))
    return df.join(bounds, F.col(key).eqNullSafe(F.col("__hot")), "left").withColumn(
        out, F.when(F.col("__bounds").isNull() | v.isNull(), 0).otherwise(below)).drop("__hot", "__bounds")


def running_count(df: DataFrame, key: str, order: Sequence[str], out: str,
                  flag: Column | None = None, inclusive: bool = False,
                  width: int = 3600, slices: int = 1, least: int = 1_000_000) -> DataFrame:
    """For each row, how many rows of the same ``key`` with ``flag`` true come
    before it under ``order`` (ASC, NULLs last; ``inclusive`` counts the row itself).

    The one-at-a-time budget of D4/D5 and the billing fold's checkout epochs,
    as a prefix sum that no hot key can pin to one task:

    1. the first order column cuts each key's rows into slices of ``width``
       seconds or units;
    2. a partial aggregate gives each slice's total, and a window over these
       totals (a row per slice, not per row of the table) the count before it;
    3. a window inside each (key, slice) adds the count within the slice.

    All of it is one lazy plan of built-in operators: nothing is written, no
    job runs while it is built, and values pass through untouched.  Choose
    ``width`` so that a hot key's busiest slice fits one task; where a burst may
    put a hot key's rows into few slices, ``slices`` > 1 cuts the keys of more
    than ``least`` rows into that many slices of equal counts as well
    (``equal_slices``: one more aggregate and a join on the hot keys).
    ``order`` must make the order total (end with a unique column).
    """
    f = F.lit(True) if flag is None else flag
    columns = df.columns
    number = F.lit(0)
    if slices > 1:
        df, number = equal_slices(df, key, order[0], slices, least, "__e"), F.col("__e")
    # structs compare NULLs as equal, so NULL keys and slices join to themselves
    src = (df.withColumn("__f", F.coalesce(f, F.lit(False)).cast("long"))
           .withColumn("__k", F.struct(F.col(key).alias("k")))
           .withColumn("__s", F.struct(order_slice(df, order[0], width).alias("s"), number.alias("e"))))
    slices = src.groupBy("__k", "__s").agg(F.sum("__f").alias("__n"))
    earlier = Window.partitionBy("__k").orderBy(F.col("__s.s").asc_nulls_last(), "__s.e").rowsBetween(
        Window.unboundedPreceding, -1)
    slices = slices.select("__k", "__s", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__k", "__s").orderBy(
        *[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    j = src.withColumn("__in", F.sum("__f").over(within)).join(slices, ["__k", "__s"])
    val = F.col("__before") + F.col("__in")
    return j.select(*columns, (val if inclusive else val - F.col("__f")).alias(out))


def rank_in_key(df: DataFrame, key: str, order: Sequence[str], out: str, **slicing) -> DataFrame:
    """1-based position of each row within its key under ``order`` (ASC), via
    ``running_count`` so a hot key is spread over many tasks."""
    return running_count(df, key, order, out, inclusive=True, **slicing)


def distinct_ids(df: DataFrame, keys: Sequence[str], col: str, out: str, aggs: dict[str, Column]) -> DataFrame:
    """COUNT(DISTINCT ``col``) per key as exact bitmaps, with the sums of ``aggs``.

    Rows are aggregated per (key, bitmap bucket), then the buckets' bit counts
    are added: no ``Expand``, and a hot key's ids are spread by bucket.  A
    bucket takes 4 KB for up to 32,768 neighbouring ids, so it is for few keys
    over dense whole-number ids; many keys with scattered ids are better off
    with a plain distinct count.  NULL ids are not counted.
    """
    id_ = F.col(col).cast("long")
    part = df.groupBy(*keys, F.bitmap_bucket_number(id_).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(id_)).alias("__bits"), *[a.alias(n) for n, a in aggs.items()])
    return part.groupBy(*keys).agg(F.sum(F.bitmap_count("__bits")).cast("long").alias(out),
                                   *[F.sum(n).alias(n) for n in aggs])


# --------------------------------------------------------------------------- joins
def heavy_keys(df: DataFrame, on: Sequence[str], least: int, top: int = 1000) -> Column:
    """Into how many slices of about ``least`` rows the key of a row is to be
    cut: 1 but for the keys of more than ``least`` rows in ``df``, told by a
    frequent-items sketch of ``top`` items (one small row, merged map-side, as a
    scalar subquery of the plan).

    A key that the sketch names does occur in ``df``; its count is an estimate
    and changes the number of slices only.
    """
    key = F.col(on[0]).cast("string") if len(on) == 1 else F.to_json(F.struct(*on))
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in on])
    found = df.where(known).select(key.alias("__key")).agg(
        F.expr(f"approx_top_k(__key, {top}, {4 * top})").alias("__top"))
    heavy = F.filter("__top", lambda x: x["item"].isNotNull() & (x["count"] > least))
    slices = found.select(F.map_from_entries(F.transform(heavy, lambda x: F.struct(
        x["item"].alias("key"), F.ceil(x["count"] / least).cast("int").alias("value")))).alias("__slices"))
    return F.coalesce(F.element_at(slices.scalar(), key), F.lit(1))


def left_join_fact(left: DataFrame, right: DataFrame, on: Sequence[str], least: int = 1_000_000) -> DataFrame:
    """``left LEFT JOIN right USING (on)`` for a small ``left`` and a large
    ``right`` whose keys may be hot.

    A plain left outer join cannot have its right side split by AQE's skew
    handling, so one hot key would land in one task.  Here the keys of more than
    ``least`` right rows are found by a sketch of the key columns, and only they
    are cut into slices: their right rows by a hash of the row, their left rows
    once per slice.  One outer join on (key, slice) then gives matched and
    unmatched rows; a hot key has partners, so its empty slices are dropped.
    """
    on, columns = list(on), [*on, *[c for c in (*left.columns, *right.columns) if c not in on]]
    dealt = right.withColumn("__slices", heavy_keys(right, on, least)).withColumn(
        "__slice", F.when(F.col("__slices") > 1, F.pmod(F.xxhash64(*right.columns), "__slices")).otherwise(0).cast("int")
    ).drop("__slices").withColumn("__hit", F.lit(True))
    spread = left.withColumn("__slices", heavy_keys(right, on, least)).withColumn(
        "__slice", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1)))
    j = spread.join(dealt, [*on, "__slice"], "left")
    return j.where(F.col("__hit").isNotNull() | (F.col("__slices") == 1)).select(*columns)


# --------------------------------------------------------------------------- tenants
def for_tenants(df: DataFrame, col: str, ids=None) -> DataFrame:
    """The optional tenant filter of every report: rows whose ``col`` is one
    of ``ids`` (all rows when ``ids`` is None).

    Apply it to a report's inputs, on the column that carries the tenant
    (``businesses.id``, ``payments.business_id``, ``referrals.referrer_id``,
    ...).  A short Python list becomes an ``IN`` predicate that reaches the
    parquet scan as a pushed filter; a DataFrame of ids (first column) becomes
    a semi join, broadcast by AQE only when its measured size allows.  A
    report keyed by the tenant gives the same rows for those tenants as the
    all-tenant run.
    """
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        keys = ids.select(F.col(ids.columns[0]).alias("__tenant")).distinct()
        return df.join(keys, F.col(col) == F.col("__tenant"), "left_semi")
    return df.where(F.col(col).isin(list(ids)))
