"""Referrals, sellers and salespeople: leaderboards and dashboards (R11-R15,
R20-R26), the two referral-status rules (D1, D2) and the referral jobs
(M1-M3, M20).

Each report keeps its own definition of "active" and of commission (X5, X6).
The referrer key is ``referrer_id`` everywhere (X2).
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import COMMISSION_RATE, FLAT_EARNING, REFERRAL_CODE_LENGTH, SIGNUP_PATH
from ..functions.scalar import as_of_lit, keyed_code, money_out, next_month_start
from ..session import scratch_path
from .accounts import DETAIL
from .common import apply_patch, earliest_by_key, left_join_fact, sum0
from .subscriptions import current_subscriptions

_FANOUTS = ("aggregate", "as_written")


def newest_first(col: str, *more: str, tenant: str = "referrer_id") -> list[Column]:
    """Order of a per-tenant list: tenant, then newest (NULL dates first, as
    PostgreSQL sorts DESC), then id and ``more`` to break ties."""
    return [F.col(tenant), F.col(col).desc_nulls_first(), F.col("id").desc(),
            *[F.col(c).desc_nulls_first() for c in more]]


def rate_lit(rate) -> Column:
    """A rate as an exact decimal with its own digits (0.125 stays 0.125)."""
    return F.lit(Decimal(str(rate)))


def _one(c) -> Column:
    return F.greatest(F.coalesce(c, F.lit(0)), F.lit(1))


def _with_zero_rows(agg: DataFrame, accounts: DataFrame | None, zeros: dict) -> DataFrame:
    """Give every account in ``accounts`` (a frame with ``id``) a row, with
    ``zeros`` filling the measures of accounts that have no referral."""
    if accounts is None:
        return agg
    j = accounts.select(F.col("id").alias("referrer_id")).join(agg, "referrer_id", "left")
    return j.select(*[F.coalesce(F.col(c), zeros[c]).alias(c) if c in zeros else F.col(c)
                      for c in agg.columns])


# ------------------------------------------------------------------ rules D1, D2
def referral_status_active_first(sub_status: Column, onboarded: Column) -> Column:
    """Active subscription first, then onboarded -> pending_subscription,
    else pending_onboarding (SQL CASE: a NULL flag is not onboarded)."""
    return (F.when(sub_status == "active", "active")
            .when(F.coalesce(onboarded, F.lit(False)), "pending_subscription")
            .otherwise("pending_onboarding"))


def referral_status_onboarding_first(sub_status: Column, onboarded: Column) -> Column:
    """Not onboarded (NULL too) -> pending_onboarding; then anything but an
    active subscription (NULL too) -> pending_subscription; else active."""
    return (F.when(~F.coalesce(onboarded, F.lit(False)), "pending_onboarding")
            .when(~F.coalesce(sub_status == "active", F.lit(False)), "pending_subscription")
            .otherwise("active"))


def _referred(referrals: DataFrame, businesses: DataFrame, subscriptions: DataFrame,
              *bcols: str) -> DataFrame:
    """Referrals with the referred business's columns and current subscription status."""
    b = businesses.select(F.col("id").alias("referred_business_id"), *bcols)
    s = current_subscriptions(subscriptions, "status").select(
        F.col("business_id").alias("referred_business_id"),
        F.col("status").alias("subscription_status"))
    return referrals.join(b, "referred_business_id", "left").join(s, "referred_business_id", "left")


def referral_statuses(referrals: DataFrame, businesses: DataFrame,
                      subscriptions: DataFrame) -> DataFrame:
    """D1 and D2 side by side for every referral (they differ for an active,
    not-onboarded business: X8)."""
    j = _referred(referrals, businesses, subscriptions, "onboarding_completed")
    return j.select("id", "referrer_id", "referred_business_id",
                    referral_status_active_first(F.col("subscription_status"),
                                                 F.col("onboarding_completed")).alias("status_active_first"),
                    referral_status_onboarding_first(F.col("subscription_status"),
                                                     F.col("onboarding_completed")).alias("status_onboarding_first"))


# ------------------------------------------------------------------ admin reports
def salespeople_leaderboard(businesses: DataFrame, referrals: DataFrame,
                            subscriptions: DataFrame, earnings: DataFrame,
                            fanout: str = "aggregate") -> DataFrame:
    """Per salesperson: referrals, referred businesses with an active
    subscription, commission (sum of earnings as seller) and last payout.

    ``as_written`` multiplies the commission by the number of
    referral x subscription rows the reference joins next to it (X4)."""
    if fanout not in _FANOUTS:
        raise ValueError(fanout)
    sp = businesses.where(F.col("is_salesperson")).select("id", F.col("business_name").alias("name"))
    if fanout == "aggregate":
        s = current_subscriptions(subscriptions, "status").select(
            F.col("business_id").alias("referred_business_id"),
            (F.col("status") == "active").alias("s_active"), F.lit(1).alias("s_n"))
    else:
        s = subscriptions.groupBy(F.col("business_id").alias("referred_business_id")).agg(
            F.max(F.coalesce(F.col("status") == "active", F.lit(False))).alias("s_active"),
            F.count(F.lit(1)).alias("s_n"))
    r = (referrals.select("id", "referrer_id", "referred_business_id")
         .join(s, "referred_business_id", "left")
         .groupBy(F.col("referrer_id").alias("id")).agg(
             F.count("id").alias("total_referrals"),
             F.count_distinct(F.when(F.col("s_active"), F.col("referred_business_id")))
             .alias("active_referrals"),
             F.sum(_one(F.col("s_n"))).alias("rs_rows")))
    e = earnings.groupBy(F.col("seller_id").alias("id")).agg(
        F.sum("amount").alias("e_sum"), F.max("created_at").alias("last_payout"))
    j = sp.join(r, "id", "left").join(e, "id", "left")
    total = F.col("e_sum") if fanout == "aggregate" else F.col("e_sum") * _one(F.col("rs_rows"))
    zero = F.lit(0).cast("long")
    return j.select("id", "name",
                    F.coalesce("total_referrals", zero).alias("total_referrals"),
                    F.coalesce("active_referrals", zero).alias("active_referrals"),
                    money_out(F.coalesce(total, F.lit(0))).alias("total_commission"),
                    "last_payout").orderBy(F.col("total_commission").desc_nulls_first(), "id")


def salesperson_detail(businesses: DataFrame, referrals: DataFrame,
                       commissions: DataFrame) -> DataFrame:
    """Salesperson detail: referrals, commission sum (commissions table),
    active = referred business's denormalised status is active."""
    c = commissions.groupBy(F.col("referral_id").alias("id")).agg(F.sum("amount").alias("c_sum"))
    r2 = businesses.select(F.col("id").alias("referred_business_id"),
                           F.col("subscription_status").alias("r2_status"))
    r = (referrals.select("id", "referrer_id", "referred_business_id")
         .join(r2, "referred_business_id", "left").join(c, "id", "left")
         .groupBy(F.col("referrer_id").alias("id")).agg(
             F.count("id").alias("total_referrals"),
             F.sum("c_sum").alias("total_commission"),
             F.count(F.when(F.col("r2_status") == "active", F.col("id")))
             .alias("active_referrals")))
    zero = F.lit(0).cast("long")
    return (businesses.where(F.col("is_salesperson")).select(*DETAIL).join(r, "id", "left")
            .select(*DETAIL, F.coalesce("total_referrals", zero).alias("total_referrals"),
                    money_out(F.coalesce("total_commission", F.lit(0))).alias("total_commission"),
                    F.coalesce("active_referrals", zero).alias("active_referrals")))


def salesperson_referrals(referrals: DataFrame, businesses: DataFrame,
                          subscriptions: DataFrame, earnings: DataFrame) -> DataFrame:
    """Each referral with the referred business (inner), its subscription
    status, and every earning of the (seller, business) pair (two-key left join)."""
    e = earnings.select(F.col("seller_id").alias("referrer_id"),
                        F.col("business_id").alias("referred_business_id"),
                        F.col("id").alias("e_id"), F.col("amount").alias("e_amount"),
                        F.col("status").alias("payment_status"))
    j = (referrals.select("id", "referrer_id", "referred_business_id", "created_at")
         .join(businesses.select(F.col("id").alias("referred_business_id"),
                                 F.col("business_name").alias("referred_business")),
               "referred_business_id")
         .join(current_subscriptions(subscriptions, "status").select(
             F.col("business_id").alias("referred_business_id"),
             F.col("status").alias("subscription_status")), "referred_business_id", "left"))
    j = left_join_fact(j, e, ["referrer_id", "referred_business_id"])
    return j.select("referrer_id", "id", "referred_business", "subscription_status",
                    F.col("created_at").alias("referral_date"),
                    money_out(F.col("e_amount")).alias("commission_amount"), "payment_status",
                    F.col("e_id").alias("__e")).orderBy(*newest_first("referral_date", "__e")).drop("__e")


def salesperson_payouts(earnings: DataFrame, businesses: DataFrame) -> DataFrame:
    """Earnings of each seller with the earning business's name."""
    return earnings.join(businesses.select(F.col("id").alias("business_id"),
                                           F.col("business_name").alias("referred_business")),
                         "business_id").select(
        "seller_id", "id", money_out(F.col("amount")).alias("amount"), "status",
        F.col("created_at").alias("payment_date"), "referred_business").orderBy(
        *newest_first("payment_date", tenant="seller_id"))


def earnings_stats(businesses: DataFrame, referrals: DataFrame, earnings: DataFrame,
                   subscriptions: DataFrame, fanout: str = "aggregate") -> DataFrame:
    """Per business as referrer: total and pending earnings, referrals,
    and conversion rate (% of referrals whose business's subscription is
    active, one decimal, NULL without referrals).  Businesses with nothing get
    zeros."""
    if fanout not in _FANOUTS:
        raise ValueError(fanout)
    if fanout == "aggregate":
        s = current_subscriptions(subscriptions, "status").select(
            F.col("business_id").alias("referred_business_id"),
            (F.col("status") == "active").alias("s_active"), F.lit(1).alias("s_n"))
    else:
        s = subscriptions.groupBy(F.col("business_id").alias("referred_business_id")).agg(
            F.max(F.coalesce(F.col("status") == "active", F.lit(False))).alias("s_active"),
            F.count(F.lit(1)).alias("s_n"))
    r = (referrals.select("id", "referrer_id", "referred_business_id")
         .join(s, "referred_business_id", "left")
         .groupBy(F.col("referrer_id").alias("bid")).agg(
             F.count("id").alias("n_ref"),
             F.count(F.when(F.col("s_active"), F.col("id"))).alias("n_active"),
             F.sum(_one(F.col("s_n"))).alias("rs_rows")))
    e = earnings.groupBy(F.col("seller_id").alias("bid")).agg(
        F.sum("amount").alias("e_sum"),
        F.sum(F.when(F.col("status") == "pending", F.col("amount")).otherwise(0)).alias("e_pending"))
    j = businesses.select(F.col("id").alias("bid")).join(r, "bid", "left").join(e, "bid", "left")
    mult = F.lit(1) if fanout == "aggregate" else _one(F.col("rs_rows"))
    n_ref = F.coalesce("n_ref", F.lit(0).cast("long"))
    return j.select(
        F.col("bid").alias("business_id"),
        money_out(F.coalesce(F.col("e_sum") * mult, F.lit(0))).alias("total_earnings"),
        money_out(F.coalesce(F.col("e_pending") * mult, F.lit(0))).alias("pending_payments"),
        n_ref.alias("successful_referrals"),
        F.when(n_ref == 0, F.lit(None).cast("double")).otherwise(
            F.floor((F.col("n_active") * 2000 + n_ref) / (n_ref * 2)).cast("double") / 10.0)
        .alias("conversion_rate"))


# ------------------------------------------------------------------ dashboards
def referral_totals(referrals: DataFrame, subscriptions: DataFrame,
                    earnings: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Per referrer: referrals, those whose business subscription is
    active, and earnings of the (referrer, referred business) pairs.  With
    ``accounts`` every account gets a row, zeros when it has no referral."""
    s = current_subscriptions(subscriptions, "status").select(
        F.col("business_id").alias("referred_business_id"), F.col("status").alias("s_status"))
    e = earnings.groupBy(F.col("seller_id").alias("referrer_id"),
                         F.col("business_id").alias("referred_business_id")).agg(
        F.sum("amount").alias("e_sum"))
    j = (referrals.select("id", "referrer_id", "referred_business_id")
         .join(s, "referred_business_id", "left")
         .join(e, ["referrer_id", "referred_business_id"], "left"))
    agg = j.groupBy("referrer_id").agg(
        F.count("id").alias("total_referrals"),
        F.count(F.when(F.col("s_status") == "active", F.col("id"))).alias("active_referrals"),
        money_out(sum0(F.col("e_sum"))).alias("total_earnings"))
    zero = F.lit(0).cast("long")
    return _with_zero_rows(agg, accounts, {"total_referrals": zero, "active_referrals": zero,
                                           "total_earnings": F.lit(0.0)})


def referral_rows(referrals: DataFrame, businesses: DataFrame, subscriptions: DataFrame,
                  earnings: DataFrame) -> DataFrame:
    """Referral dashboard rows with the D1 status; one row per matching
    earning of the (referrer, referred business) pair, 0 when none."""
    j = _referred(referrals.select("id", "referrer_id", "referred_business_id", "created_at"),
                  businesses, subscriptions, F.col("business_name").alias("referred_business"),
                  F.col("email").alias("referred_email"), "onboarding_completed")
    e = earnings.select(F.col("seller_id").alias("referrer_id"),
                        F.col("business_id").alias("referred_business_id"),
                        F.col("id").alias("e_id"), F.col("amount").alias("e_amount"))
    j = left_join_fact(j, e, ["referrer_id", "referred_business_id"])
    return j.orderBy(*newest_first("created_at", "e_id")).select(
        "id", "referrer_id", "referred_business_id", "referred_business", "referred_email",
        referral_status_active_first(F.col("subscription_status"),
                                     F.col("onboarding_completed")).alias("status"),
        "created_at", money_out(F.coalesce("e_amount", F.lit(0))).alias("earnings"),
        "onboarding_completed", "subscription_status")


def seller_totals(referrals: DataFrame, earnings: DataFrame, as_of,
                  sellers: DataFrame | None = None) -> DataFrame:
    """Per seller: referrals, active referrals (referral status), total
    and pending earnings through the referral, next payout date (first of
    next month, midnight: F12).  With ``sellers`` every seller gets a row,
    zeros when it has no referral."""
    e = earnings.groupBy(F.col("referral_id").alias("id")).agg(
        F.sum("amount").alias("e_sum"),
        F.sum(F.when(F.col("status") == "pending", F.col("amount")).otherwise(0)).alias("e_pending"))
    j = referrals.select("id", "referrer_id", "status").join(e, "id", "left")
    agg = j.groupBy("referrer_id").agg(
        F.count("id").alias("total_referrals"),
        F.count(F.when(F.col("status") == "active", F.col("id"))).alias("active_referrals"),
        money_out(sum0(F.col("e_sum"))).alias("total_earnings"),
        money_out(sum0(F.col("e_pending"))).alias("pending_earnings"))
    zero = F.lit(0).cast("long")
    agg = _with_zero_rows(agg, sellers, {"total_referrals": zero, "active_referrals": zero,
                                         "total_earnings": F.lit(0.0), "pending_earnings": F.lit(0.0)})
    return agg.withColumn("next_payout_date", next_month_start(as_of_lit(as_of)))


def seller_referrals(referrals: DataFrame, businesses: DataFrame, subscriptions: DataFrame,
                     earnings: DataFrame) -> DataFrame:
    """seller's referral rows: earnings per referral and the D2 status."""
    e = earnings.groupBy(F.col("referral_id").alias("id")).agg(F.sum("amount").alias("e_sum"))
    j = _referred(referrals.select("id", "referrer_id", "referred_business_id", "created_at"),
                  businesses, subscriptions, "business_name", "email", "onboarding_completed") \
        .join(e, "id", "left")
    return j.select("referrer_id", "id", "business_name", "email",
                    referral_status_onboarding_first(F.col("subscription_status"),
                                                     F.col("onboarding_completed")).alias("status"),
                    F.col("created_at").alias("join_date"),
                    money_out(F.coalesce("e_sum", F.lit(0))).alias("earnings")).orderBy(
        *newest_first("join_date"))


def seller_payouts(earnings: DataFrame, referrals: DataFrame, businesses: DataFrame) -> DataFrame:
    """Earnings through the seller's referrals, with the business name."""
    r = referrals.select(F.col("id").alias("referral_id"), "referrer_id", "referred_business_id")
    b = businesses.select(F.col("id").alias("referred_business_id"), "business_name")
    return (earnings.join(r, "referral_id").join(b, "referred_business_id")
            .select("referrer_id", "id", money_out(F.col("amount")).alias("amount"), "status",
                    F.col("created_at").alias("date"), "business_name")
            .orderBy(*newest_first("date")))


def salesperson_totals(referrals: DataFrame, businesses: DataFrame, as_of,
                       rate: float = COMMISSION_RATE, salespeople: DataFrame | None = None) -> DataFrame:
    """Per salesperson: commission recorded on referrals, active referred
    businesses (denormalised status), next payout = rate x subscription amount
    of active referred businesses whose commission is unpaid.  With
    ``salespeople`` every salesperson gets a row, zeros when it has none."""
    b = businesses.select(F.col("id").alias("referred_business_id"),
                          F.col("subscription_status").alias("b_status"), "subscription_amount")
    j = referrals.join(b, "referred_business_id", "left")
    r = rate_lit(rate)
    due = F.when((F.col("b_status") == "active") & (F.col("commission_paid") == F.lit(False)),
                 F.col("subscription_amount") * r).otherwise(F.lit(0))
    agg = j.groupBy("referrer_id").agg(
        money_out(F.coalesce(F.sum("commission_amount"), F.lit(0))).alias("total_commission"),
        F.count(F.when(F.col("b_status") == "active", F.col("id"))).alias("active_referrals"),
        money_out(F.coalesce(F.sum(due), F.lit(0))).alias("next_payout_amount"))
    agg = _with_zero_rows(agg, salespeople, {"total_commission": F.lit(0.0),
                                             "active_referrals": F.lit(0).cast("long"),
                                             "next_payout_amount": F.lit(0.0)})
    return agg.withColumn("next_payout_date", next_month_start(as_of_lit(as_of)))


def salesperson_referral_payments(referrals: DataFrame, businesses: DataFrame,
                                  payments: DataFrame, rate: float = COMMISSION_RATE) -> DataFrame:
    """Referred businesses, one row per (referral, payment time): the
    payment time is a group key as in the reference; commission = rate x the
    payments at that time."""
    b = businesses.select(F.col("id").alias("referred_business_id"), "business_name",
                          "owner_name", F.col("subscription_status").alias("status"),
                          F.col("created_at").alias("join_date"))
    p = payments.select(F.col("business_id").alias("referred_business_id"),
                        F.col("created_at").alias("last_payment"), "amount")
    j = left_join_fact(referrals.select("id", "referrer_id", "referred_business_id").join(
        b, "referred_business_id"), p, ["referred_business_id"])
    r = rate_lit(rate)
    return j.groupBy("referrer_id", "id", "business_name", "owner_name", "status", "join_date",
                     "last_payment").agg(
        money_out(F.coalesce(F.sum(F.col("amount") * r), F.lit(0))).alias("commission")).orderBy(
        *newest_first("join_date", "last_payment"))


# ------------------------------------------------------------------ jobs
def activate_referrals(referrals: DataFrame, businesses: DataFrame) -> DataFrame:
    """M1: pending referrals whose referred business finished onboarding
    become active (UPDATE .. FROM as a keyed patch)."""
    onboarded = businesses.where(F.col("onboarding_completed") == F.lit(True)).select(
        F.col("id").alias("referred_business_id")).distinct()
    pending = referrals.where(F.col("status") == "pending").select(
        "id", "referred_business_id").join(onboarded, "referred_business_id", "left_semi")
    return apply_patch(referrals, pending.select("id"), ["id"], {"status": F.lit("active")},
                       patch_cols=[], flag="changed")


def monthly_earnings(referrals: DataFrame, subscriptions: DataFrame, earnings: DataFrame,
                     month, as_of, rate: float = COMMISSION_RATE, unit_divisor: int = 1,
                     as_written: bool = False) -> DataFrame:
    """M2: one earning per active referral and its subscription: rate x the
    subscription amount (stored in cents; ``unit_divisor`` converts, X7).

    Default: one row per (referral, month) from the current subscription, and
    pairs already in ``earnings`` for that month are skipped, so a rerun adds
    nothing (X21).  ``as_written`` joins every subscription row and appends
    unconditionally, as the reference does."""
    m = F.date_trunc("month", as_of_lit(month))
    subs = subscriptions if as_written else current_subscriptions(subscriptions, "amount")
    s = subs.select(F.col("business_id").alias("referred_business_id"), F.col("amount").alias("s_amount"))
    r = rate_lit(rate)
    rows = (referrals.where(F.col("status") == "active")
            .select(F.col("id").alias("referral_id"), F.col("referrer_id").alias("seller_id"),
                    "referred_business_id")
            .join(s, "referred_business_id")
            .select("referral_id", "seller_id", F.col("referred_business_id").alias("business_id"),
                    (F.col("s_amount").cast("decimal(18,2)") / F.lit(unit_divisor) * r)
                    .cast("decimal(18,2)").alias("amount"),
                    F.lit("pending").alias("status"), m.alias("month"),
                    as_of_lit(as_of).alias("created_at")))
    if not as_written:
        have = earnings.where(F.col("month") == m).select("referral_id").distinct()
        rows = rows.join(have, "referral_id", "left_anti")
    return rows


def payment_earnings(payments: DataFrame, referrals: DataFrame, flat: float = FLAT_EARNING) -> DataFrame:
    """M3: a flat earning per payment for the payer's first active referral
    (lowest id; the reference takes an unordered first row), stamped with the
    payment's month.  The payment amount is ignored, as in the reference."""
    first = earliest_by_key(referrals.where(F.col("status") == "active"),
                            ["referred_business_id"], ["id"],
                            ["referred_business_id", "id", "referrer_id"])
    return payments.select(F.col("id").alias("payment_id"), "business_id", "created_at").join(
        first.select(F.col("referred_business_id").alias("business_id"),
                     F.col("id").alias("referral_id"), F.col("referrer_id").alias("seller_id")),
        "business_id").select(
        "payment_id", "referral_id", "seller_id", "business_id",
        F.lit(flat).cast("decimal(18,2)").alias("amount"),
        F.date_trunc("month", "created_at").alias("month"))


def _drawn_code(business: Column, attempt: int) -> Column:
    return keyed_code(business, F.lit(attempt), length=REFERRAL_CODE_LENGTH)


def fill_referral_codes(businesses: DataFrame, base_url: str,
                        draw: Callable[[Column, int], Column] = _drawn_code, max_rounds: int = 100) -> DataFrame:
    """Keep existing referral codes; give the others a deterministic
    8-character base-36 code derived from the id (F17), and build the signup
    link.  No business is left without a code and no generated code is shared.

    One aggregate over the codes finds those that clash: drawn by several
    businesses, or stored already.  The lowest id keeps a code that is not
    stored; the others draw again, round by round until none clashes, and each
    round looks at their new codes alone.  Without a clash the result is a
    projection of one scan.  ``draw`` makes the code of (id, attempt); one that
    never gets free raises after ``max_rounds``.
    """
    stored, drawn = F.col("referral_code").isNotNull(), F.coalesce("referral_code", draw(F.col("id"), 0))
    codes = businesses.select("id", drawn.alias("code"), stored.alias("stored"))

    def losers(codes: DataFrame) -> DataFrame:
        """(id, code) of the generated codes that must be drawn again."""
        clash = codes.groupBy("code").agg(F.max("stored").alias("taken"), F.count(F.when(~F.col("stored"), 1)).alias("n"),
                                          F.min(F.when(~F.col("stored"), F.col("id"))).alias("winner"))
        clash = clash.where((F.col("n") > 1) | (F.col("taken") & (F.col("n") > 0)))
        back = codes.where(~F.col("stored")).join(clash, "code").where(F.col("taken") | (F.col("id") != F.col("winner")))
        return _written(back.select("id", "code"), "code-clashes")

    again, given = losers(codes), None
    settled = codes.join(again.select("id"), "id", "left_anti").select("code")
    for attempt in range(1, max_rounds):
        if again.isEmpty():
            break
        new = _written(again.select("id", draw(F.col("id"), attempt).alias("code")), "code-draws")
        # all codes that others have, of those now drawn
        held = settled if given is None else settled.unionByName(given.select("code"))
        held = held.join(new.select("code").distinct(), "code", "left_semi").distinct()
        tried = new.withColumn("stored", F.lit(False)).unionByName(
            held.select(F.lit(None).cast(new.schema["id"].dataType).alias("id"), "code", F.lit(True).alias("stored")))
        lost = losers(tried)
        won = new.join(lost.select("id"), "id", "left_anti")
        given = _written(won if given is None else given.unionByName(won), "codes-given")
        again = lost
    else:
        raise RuntimeError(f"referral codes still clash after {max_rounds} draws")
    code = drawn
    if given is not None:
        businesses = businesses.join(given.select("id", F.col("code").alias("__code")), "id", "left")
        code = F.coalesce("referral_code", F.col("__code"), draw(F.col("id"), 0))
    return businesses.select("id", code.alias("referral_code"), F.col("referral_code").isNull().alias("generated"),
                             F.concat(F.lit(base_url), F.lit(SIGNUP_PATH), code).alias("referral_link"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def referral_code_collisions(codes: DataFrame) -> DataFrame:
    """Codes held by more than one business after M20 (expected empty)."""
    return codes.groupBy("referral_code").agg(F.count(F.lit(1)).alias("holders")) \
        .where(F.col("holders") > 1)
