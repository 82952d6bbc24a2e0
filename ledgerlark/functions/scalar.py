"""Scalar helpers.  Each returns a Column built from Spark built-ins, so it
stays inside whole-stage codegen.  Arguments are Columns; a plain Python value
is taken as a literal (pass ``F.col(name)`` for a column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "money_out", "or_default", "or_default_num", "next_month_start", "capitalize_first",
    "card_label", "keyed_id", "keyed_code", "usd", "fixed2", "full_match", "us_date",
    "ratio_round1", "percent_round1", "as_of_lit", "col_or_lit",
]


def col_or_lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def as_of_lit(as_of) -> Column:
    """F8: the job's notion of "now" as a timestamp literal (never the wall clock)."""
    return F.to_timestamp(F.lit(str(as_of)))


def money_out(c) -> Column:
    """Money at the edge: exact decimal inside, double rounded to cents out."""
    return F.round(col_or_lit(c).cast("double"), 2)


def or_default(c, default) -> Column:
    """JS ``x || d`` for text (NULL and '' both mean missing)."""
    c = col_or_lit(c)
    return F.coalesce(F.nullif(c, F.lit("")), col_or_lit(default))


def or_default_num(c, default) -> Column:
    """JS ``x || d`` for numbers (NULL and 0 both mean missing)."""
    c = col_or_lit(c)
    return F.when(c.isNull() | (c == 0), col_or_lit(default)).otherwise(c)


def next_month_start(ts) -> Column:
    """midnight of the first day of the next month."""
    return F.trunc(F.add_months(col_or_lit(ts), 1), "month").cast("timestamp")


def capitalize_first(s) -> Column:
    """upper-case the first letter only (unlike initcap)."""
    s = col_or_lit(s)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def card_label(brand, last4) -> Column:
    """'Brand ending in 1234' when both parts are present, else NULL."""
    brand, last4 = col_or_lit(brand), col_or_lit(last4)
    ok = (F.coalesce(brand, F.lit("")) != "") & (F.coalesce(last4, F.lit("")) != "")
    from ..fixed import CARD_LABEL_JOIN
    return F.when(ok, F.concat(capitalize_first(brand), F.lit(CARD_LABEL_JOIN), last4))


def keyed_id(*parts, length: int = 15) -> Column:
    """F16: deterministic id from a key, so reruns give the same value."""
    key = F.concat_ws("|", *[col_or_lit(p).cast("string") for p in parts])
    return F.substring(F.sha2(key, 256), 1, length)


def keyed_code(*parts, length: int = 8) -> Column:
    """deterministic base-36 code from a key (60 bits of its hash)."""
    bits = F.conv(keyed_id(*parts, length=15), 16, 10).cast("long")
    return F.lpad(F.conv((bits % 36 ** length).cast("string"), 10, 36), length, "0")


def usd(x) -> Column:
    """US dollar text, minus sign before the dollar sign: -$1,234.50."""
    x = col_or_lit(x)
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"),
                    F.format_number(F.abs(x), 2))


def fixed2(x) -> Column:
    """two fixed decimals as text (exact: via decimal(38,2), half up)."""
    return col_or_lit(x).cast("decimal(38,2)").cast("string")


def full_match(c, pattern: str) -> Column:
    """whole-string regex test; ``\\z`` so a trailing newline fails."""
    return F.coalesce(col_or_lit(c).rlike(r"\A(?:" + pattern + r")\z"), F.lit(False))


def us_date(ts) -> Column:
    """locale date text M/d/yyyy."""
    return F.date_format(col_or_lit(ts), "M/d/yyyy")


def ratio_round1(num, den) -> Column:
    """round(num / den, 1) half-up, exact, for non-negative integers; NULL if den = 0."""
    num, den = col_or_lit(num).cast("long"), col_or_lit(den).cast("long")
    q = F.floor((num * 20 + den) / (den * 2))
    return F.when(den == 0, F.lit(None)).otherwise(q.cast("double") / 10.0)


def percent_round1(num, den) -> Column:
    """round(100 * num / den, 1) half-up, exact; NULL when den = 0 (NULLIF)."""
    return ratio_round1(col_or_lit(num).cast("long") * 100, den)
