"""Coupons: usage list (R27), attempt decisions (D5), code format (D7),
trial redemption (M4), create / deactivate (M19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import COUPON_CODE_PATTERN
from ..functions.scalar import as_of_lit, full_match
from .common import Desc, apply_patch, earliest_by_key, latest_by_key, running_count


COUPON_COLS = ["id", "code", "description", "type", "value", "max_uses", "times_used",
               "is_active", "expires_at", "created_at"]


def redemption_counts(redemptions: DataFrame) -> DataFrame:
    return redemptions.groupBy("coupon_id").agg(F.count(F.lit(1)).alias("uses"))


def coupon_usage(coupons: DataFrame, redemptions: DataFrame) -> DataFrame:
    """Coupons with the counted number of uses (the stored times_used is
    replaced by the count, X18), newest first."""
    n = redemption_counts(redemptions).withColumnRenamed("coupon_id", "id")
    return (coupons.drop("times_used").join(n, "id", "left")
            .withColumn("times_used", F.coalesce("uses", F.lit(0).cast("long")))
            .select(*COUPON_COLS)
            .orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc()))


def coupon_code_ok(code) -> F.Column:
    """The coupon code format, whole string."""
    return full_match(code if not isinstance(code, str) else F.col(code), COUPON_CODE_PATTERN)


def coupon_decisions(attempts: DataFrame, coupons: DataFrame, redemptions: DataFrame,
                     strict: bool = False, **slicing) -> DataFrame:
    """D5 over a batch of attempts (attempt_id, code, business_id, attempted_at).

    Attempts are taken in (attempted_at, business_id, attempt_id) order per
    coupon, and each sees the state the earlier ones left, first match wins:
    ``not_found`` (upper-cased code unknown); [strict: ``inactive``,
    ``expired``]; ``max_uses`` (uses so far >= max_uses); ``already_used``
    (the business redeemed it before); else ``ok``.  Only an ok *trial*
    attempt uses the coupon (M4); discount attempts are checked, never
    recorded.

    Exact batch form: within a coupon, the trial attempts that can succeed
    are the first attempt of each (coupon, business) pair not redeemed
    before, and they succeed in order while uses remain, so the uses an
    attempt sees are ``u0 + min(firsts before it, max_uses - u0)``.  The
    "firsts before" count is a distributed prefix sum (``running_count``, whose
    ``slices``, ``least`` and ``width`` may be given for bursts on one coupon).
    """
    checked = ["is_active", "expires_at"] if strict else []
    c = earliest_by_key(coupons, ["code"], ["id"], ["code", "id", "type", "max_uses", *checked]).select(
        F.col("id").alias("coupon_id"), F.col("code").alias("__code"), F.col("type").alias("coupon_type"),
        "max_uses", *checked)
    # one pass over the redemptions: uses per (coupon, business) pair, then per coupon
    pairs = redemptions.groupBy("coupon_id", "business_id").agg(F.count(F.lit(1)).alias("__n"))
    u0 = pairs.groupBy("coupon_id").agg(F.sum("__n").alias("u0"))
    pre = pairs.select("coupon_id", "business_id", F.lit(True).alias("pre_redeemed"))
    att = attempts.select("attempt_id", "code", "business_id", "attempted_at")
    a = (att.join(c, F.upper(F.col("code")) == F.col("__code"), "left").drop("code", "__code")
         .join(u0, "coupon_id", "left")
         .join(pre, ["coupon_id", "business_id"], "left")
         .withColumn("u0", F.coalesce("u0", F.lit(0).cast("long")))
         .withColumn("pre_redeemed", F.coalesce("pre_redeemed", F.lit(False))))
    usable = F.lit(True)
    if strict:
        usable = (F.col("is_active") == F.lit(True)) & (
            F.col("expires_at").isNull() | (F.col("expires_at") > F.col("attempted_at")))
    cand = a.where((F.col("coupon_type") == "trial") & ~F.col("pre_redeemed") & usable)
    firsts = earliest_by_key(cand, ["coupon_id", "business_id"], ["attempted_at", "attempt_id"],
                             ["coupon_id", "business_id", "attempt_id"]) \
        .withColumnRenamed("attempt_id", "__first_id")
    found = a.join(firsts, ["coupon_id", "business_id"], "left").withColumn(
        "is_first", F.coalesce(F.col("attempt_id") == F.col("__first_id"), F.lit(False))).drop("__first_id")
    ranked = running_count(found, "coupon_id", ["attempted_at", "business_id", "attempt_id"],
                           "firsts_before", flag=F.col("is_first"), **slicing)
    cap = F.greatest(F.col("max_uses") - F.col("u0"), F.lit(0))
    uses = F.when(F.col("max_uses").isNull(), F.col("u0") + F.col("firsts_before")).otherwise(
        F.col("u0") + F.least(F.col("firsts_before"), cap))
    known = F.col("coupon_id").isNotNull()
    reason = F.when(~known, "not_found")
    if strict:
        reason = reason.when(~F.coalesce(F.col("is_active"), F.lit(False)), "inactive").when(
            F.col("expires_at").isNotNull() & (F.col("expires_at") <= F.col("attempted_at")), "expired")
    reason = (reason.when(F.col("max_uses").isNotNull() & (uses >= F.col("max_uses")), "max_uses")
              .when(F.col("pre_redeemed"), "already_used")
              .when((F.col("coupon_type") == "trial") & ~F.col("is_first"), "already_used")
              .otherwise("ok"))
    out = ranked.select("attempt_id", "business_id", "coupon_id", "coupon_type", "attempted_at",
                        F.when(known, uses).alias("uses_before"), reason.alias("reason"))
    return out.withColumn("ok", F.col("reason") == "ok").withColumn(
        "redeems", (F.col("reason") == "ok") & (F.col("coupon_type") == "trial"))


def redeem_trials(decisions: DataFrame, businesses: DataFrame, coupons: DataFrame,
                  redemptions: DataFrame, as_of):
    """M4: from D5's ok trial attempts: the business becomes ``trial`` with
    trial_ends_at = ``as_of`` + coupon value days (the last redemption of a
    business wins), a redemption row is added per attempt, and the coupon's
    times_used is recounted.  Returns ``(businesses, redemptions, coupons)``."""
    ok = decisions.where(F.col("redeems")).select("attempt_id", "coupon_id", "business_id",
                                                  "attempted_at")
    days = ok.join(coupons.select(F.col("id").alias("coupon_id"), "value"), "coupon_id")
    last = latest_by_key(days, ["business_id"], [Desc("attempted_at", False), Desc("attempt_id", False)],
                         ["business_id", "value", "attempted_at", "attempt_id"])
    p = last.select(F.col("business_id").alias("id"), "value")
    b = apply_patch(businesses, p, ["id"], {
        "subscription_status": F.lit("trial"),
        "trial_ends_at": as_of_lit(as_of) + F.make_dt_interval(F.col("__p_value"))},
        patch_cols=["value"], flag="changed")
    red = redemptions.unionByName(ok.select("coupon_id", "business_id"))
    n = redemption_counts(red).withColumnRenamed("coupon_id", "id")
    c = coupons.join(n, "id", "left").withColumn(
        "times_used", F.coalesce("uses", F.lit(0)).cast("int")).select(*coupons.columns)
    return b, red, c


def add_coupons(coupons: DataFrame, new: DataFrame) -> DataFrame:
    """M19 create: codes upper-cased; new coupons are active with 0 uses."""
    rows = new.select(*[
        (F.upper(F.col("code")) if c == "code" else
         F.coalesce(F.col(c), F.lit(True)) if c == "is_active" else
         F.coalesce(F.col(c), F.lit(0)) if c == "times_used" else F.col(c))
        .cast(coupons.schema[c].dataType).alias(c) for c in coupons.columns])
    return coupons.unionByName(rows)


def deactivate_coupons(coupons: DataFrame, requests: DataFrame) -> DataFrame:
    """M19 deactivate: is_active = false for the requested ids."""
    p = requests.select(F.col("coupon_id").alias("id")).distinct()
    return apply_patch(coupons, p, ["id"], {"is_active": F.lit(False)}, patch_cols=[], flag="changed")
