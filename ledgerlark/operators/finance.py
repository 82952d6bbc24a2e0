"""Finance reports: totals (R16), monthly series (R17), daily revenue (R18),
commissions per salesperson (R19).

Money is summed as decimal and turned into a 2-decimal double only at the end.
Where the reference joins two independent one-to-many sides before SUM (X4),
the default aggregates each side first; ``fanout="as_written"`` reproduces
the reference's multiplied number from per-key counts, without building the
row pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import as_of_lit, money_out
from .common import month_calendar, sum0
from .subscriptions import current_subscriptions

_FANOUTS = ("aggregate", "as_written")


def _check_fanout(fanout: str) -> None:
    if fanout not in _FANOUTS:
        raise ValueError(f"fanout must be one of {_FANOUTS}")


def financial_totals(businesses: DataFrame, subscriptions: DataFrame, payments: DataFrame,
                     earnings: DataFrame, fanout: str = "aggregate") -> DataFrame:
    """One row: total_revenue, total_commissions, active_businesses,
    total_salespeople over all businesses."""
    _check_fanout(fanout)
    pay = payments.groupBy(F.col("business_id").alias("id")).agg(
        F.sum("amount").alias("rev"), F.count(F.lit(1)).alias("n_pay"))
    ear = earnings.groupBy(F.col("seller_id").alias("id")).agg(
        F.sum("amount").alias("com"), F.count(F.lit(1)).alias("n_ear"))
    if fanout == "aggregate":
        subs = current_subscriptions(subscriptions, "status").select(
            F.col("business_id").alias("id"), (F.col("status") == "active").alias("active"),
            F.lit(1).cast("long").alias("n_sub"))
    else:
        subs = subscriptions.groupBy(F.col("business_id").alias("id")).agg(
            F.max(F.coalesce(F.col("status") == "active", F.lit(False))).alias("active"),
            F.count(F.lit(1)).alias("n_sub"))
    j = (businesses.select("id", "is_salesperson")
         .join(subs, "id", "left").join(pay, "id", "left").join(ear, "id", "left"))
    one = F.lit(1).cast("long")
    if fanout == "aggregate":
        rev, com = F.col("rev"), F.col("com")
    else:
        ns = F.greatest(F.coalesce("n_sub", one), one)
        rev = F.col("rev") * ns * F.greatest(F.coalesce("n_ear", one), one)
        com = F.col("com") * ns * F.greatest(F.coalesce("n_pay", one), one)
    return j.agg(
        money_out(sum0(rev)).alias("total_revenue"),
        money_out(sum0(com)).alias("total_commissions"),
        F.count(F.when(F.col("active"), F.col("id"))).alias("active_businesses"),
        F.count(F.when(F.col("is_salesperson"), F.col("id"))).alias("total_salespeople"),
    )


def monthly_financials(spark: SparkSession, payments: DataFrame, earnings: DataFrame,
                       as_of, months: int = 12) -> DataFrame:
    """By month, revenue and commissions for the ``months`` months up to ``as_of``'s
    month, zero-filled.  The spine decides which months appear, so the facts
    are pruned to the spine's range before grouping."""
    cal = month_calendar(spark, as_of, months)
    end = F.add_months(F.date_trunc("month", as_of_lit(as_of)), 1).cast("timestamp")
    start = F.add_months(F.date_trunc("month", as_of_lit(as_of)), -(months - 1)).cast("timestamp")

    def by_month(df: DataFrame, name: str) -> DataFrame:
        return (df.where((F.col("created_at") >= start) & (F.col("created_at") < end))
                .groupBy(F.date_trunc("month", "created_at").alias("month"))
                .agg(F.sum("amount").alias(name)))

    out = (cal.join(by_month(payments, "revenue"), "month", "left")
              .join(by_month(earnings, "commissions"), "month", "left"))
    return out.select(
        "month",
        money_out(F.coalesce("revenue", F.lit(0))).alias("revenue"),
        money_out(F.coalesce("commissions", F.lit(0))).alias("commissions")).orderBy("month")


def daily_revenue(payments: DataFrame, commissions: DataFrame, start, end,
                  fanout: str = "aggregate") -> DataFrame:
    """Per day in [start, end] (inclusive, timestamps; a date-only end
    means its midnight, X20): transactions, revenue, commissions, net."""
    _check_fanout(fanout)
    p = payments.where(F.col("created_at").between(as_of_lit(start), as_of_lit(end)))
    # only commissions of payments in the range are aggregated: a semi join on
    # the in-range payment ids first (broadcast by AQE when that side is small)
    c = (commissions.join(p.select(F.col("id").alias("payment_id")), "payment_id", "left_semi")
         .groupBy(F.col("payment_id").alias("id")).agg(
             F.sum("amount").alias("c_sum"), F.count(F.lit(1)).alias("c_n")))
    j = p.select("id", "amount", "created_at").join(c, "id", "left")
    zero = F.lit(0).cast("decimal(18,2)")
    if fanout == "aggregate":
        rev = F.col("amount")
        net = F.col("amount") - F.coalesce("c_sum", zero)
    else:
        n = F.greatest(F.coalesce("c_n", F.lit(0)), F.lit(1))
        rev = F.col("amount") * n
        net = F.col("amount") * n - F.coalesce("c_sum", zero)
    return (j.groupBy(F.date_trunc("day", "created_at").alias("date"))
             .agg(F.count("id").alias("transactions"),
                  money_out(sum0(rev)).alias("revenue"),
                  money_out(sum0(F.col("c_sum"))).alias("commissions"),
                  money_out(sum0(net)).alias("net_revenue"))
             .orderBy(F.col("date").asc_nulls_last()))


def commissions_report(businesses: DataFrame, referrals: DataFrame, commissions: DataFrame,
                       start, end) -> DataFrame:
    """R19, highest commission first: per salesperson with commissions dated in [start, end]: referrals
    with such commissions, of those active (referred business's denormalised
    status), and the commission sum.  Salespeople without any drop out (X13)."""
    c = (commissions.where(F.col("created_at").between(as_of_lit(start), as_of_lit(end)))
         .groupBy("referral_id").agg(F.sum("amount").alias("c_sum")))
    sp = businesses.where(F.col("is_salesperson")).select(
        F.col("id").alias("salesperson_id"), F.col("business_name").alias("salesperson"))
    referred = businesses.select(F.col("id").alias("referred_business_id"),
                                 F.col("subscription_status").alias("r2_status"))
    j = (referrals.select("id", "referrer_id", "referred_business_id")
         .join(c, F.col("id") == F.col("referral_id"))
         .join(sp, F.col("referrer_id") == F.col("salesperson_id"))
         .join(referred, "referred_business_id", "left"))
    return (j.groupBy("salesperson_id", "salesperson")
             .agg(F.count("id").alias("total_referrals"),
                  F.count(F.when(F.col("r2_status") == "active", F.col("id")))
                  .alias("active_referrals"),
                  money_out(sum0(F.col("c_sum"))).alias("total_commission"))
             .orderBy(F.col("total_commission").desc_nulls_first(), "salesperson_id"))
