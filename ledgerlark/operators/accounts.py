"""Business accounts: listings and details (R5-R10), subscription card (R30),
account flags (R32), access and quota rules (D3, D4), token states (D8),
referral-code attribution (D9), and account change jobs (M5, M12-M18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import (DEFAULT_PAYMENT_METHOD, INVOICE_NO_ADDRESS, INVOICE_NO_PAYMENT,
                     INVOICE_NO_STATUS, TRIAL_DAYS, TRIAL_QUOTA)
from ..functions.scalar import (as_of_lit, card_label, money_out, or_default,
                                or_default_num, us_date, usd)
from .common import Desc, above_max, apply_patch, distinct_ids, earliest_by_key, latest_by_key, rank_in_key
from .subscriptions import current_subscriptions

PROFILE = ["id", "business_name", "owner_name", "email", "phone", "address",
           "google_review_link"]
# Explicit business columns for detail views: never ``b.*`` (X14), never a password.
DETAIL = ["id", "business_name", "owner_name", "email", "phone", "address",
          "google_review_link", "referral_code", "created_at", "onboarding_completed",
          "is_salesperson", "is_admin"]


def _subs(subscriptions: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """(id, ``col`` as ``name``) of each business's current subscription."""
    return current_subscriptions(subscriptions, col).select(
        F.col("business_id").alias("id"), F.col(col).alias(name or col))


def latest_payments(payments: DataFrame) -> DataFrame:
    """Latest payment per business: created_at DESC NULLS FIRST, then id DESC
    (X9, X10); one aggregate pass gives both date and amount."""
    return latest_by_key(payments, ["business_id"],
                         [Desc("created_at"), Desc("id", nulls_first=False)],
                         ["business_id", "created_at", "amount"])


def public_listing(businesses: DataFrame, subscriptions: DataFrame, as_of) -> DataFrame:
    """Businesses shown publicly.  A ``cancelling`` business whose period
    ended strictly before ``as_of`` counts as ``pending``; ``pending`` ones are
    hidden; a NULL status stays visible."""
    j = businesses.select("id", "business_name", "google_review_link", "subscription_status") \
        .join(_subs(subscriptions, "current_period_end"), "id", "left")
    status = _expired_status(F.col("subscription_status"), F.col("current_period_end"), as_of)
    return j.where(~F.coalesce(status == "pending", F.lit(False))).select(
        "id", "business_name", "google_review_link")


def _expired_status(status, period_end, as_of):
    ended = (status == "cancelling") & period_end.isNotNull() & (period_end < as_of_lit(as_of))
    return F.when(F.coalesce(ended, F.lit(False)), F.lit("pending")).otherwise(status)


def expire_cancelling(businesses: DataFrame, subscriptions: DataFrame, as_of) -> DataFrame:
    """Batch sweep: ``cancelling`` businesses whose period ended become
    ``pending``.  Returns the new businesses snapshot with a ``changed`` flag."""
    j = businesses.join(_subs(subscriptions, "current_period_end", "__cpe"),
                        "id", "left")
    new = _expired_status(F.col("subscription_status"), F.col("__cpe"), as_of)
    changed = F.coalesce(new != F.col("subscription_status"), F.lit(False))
    return j.select(*[new.alias(c) if c == "subscription_status" else F.col(c)
                      for c in businesses.columns], changed.alias("changed"))


def business_profile(businesses: DataFrame) -> DataFrame:
    """Profile projection."""
    return businesses.select(*PROFILE)


def business_list(businesses: DataFrame, subscriptions: DataFrame,
                  payments: DataFrame) -> DataFrame:
    """Admin list of non-admin businesses (a NULL flag drops out, as in
    SQL) with subscription status and the latest payment's date and amount."""
    lp = latest_payments(payments).select(
        F.col("business_id").alias("id"), F.col("created_at").alias("last_payment_date"),
        money_out(F.col("amount")).alias("last_payment_amount"))
    return (businesses.where(F.col("is_admin") == F.lit(False))
            .select("id", "business_name", "owner_name", "email", "created_at")
            .join(_subs(subscriptions, "status", "subscription_status"), "id", "left")
            .join(lp, "id", "left")
            .orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc()))


def _referrals_as_referred(referrals: DataFrame) -> DataFrame:
    return referrals.groupBy(F.col("referred_business_id").alias("id")).agg(
        F.count("id").alias("total_referrals"),
        F.count(F.when(F.col("status") == "active", F.col("id"))).alias("active_referrals"))


def business_detail_by_referral_status(businesses: DataFrame, subscriptions: DataFrame,
                                       referrals: DataFrame) -> DataFrame:
    """Business detail with the referrals naming it as the referred party,
    counted in total and by referral status; aggregated before the join (X15)."""
    zero = F.lit(0).cast("long")
    return (businesses.select(*DETAIL)
            .join(current_subscriptions(subscriptions, "status", "current_period_end").select(
                F.col("business_id").alias("id"), F.col("status").alias("subscription_status"),
                "current_period_end"), "id", "left")
            .join(_referrals_as_referred(referrals), "id", "left")
            .withColumn("total_referrals", F.coalesce("total_referrals", zero))
            .withColumn("active_referrals", F.coalesce("active_referrals", zero)))


def business_detail(businesses: DataFrame, subscriptions: DataFrame, payments: DataFrame,
                    referrals: DataFrame) -> DataFrame:
    """Business detail with its latest payment and the referrals naming it,
    "active" meaning the referred business's own subscription is active."""
    lp = latest_payments(payments).select(
        F.col("business_id").alias("id"), money_out(F.col("amount")).alias("last_payment_amount"),
        F.col("created_at").alias("last_payment_date"))
    refs = referrals.groupBy(F.col("referred_business_id").alias("id")).agg(
        F.count("id").alias("total_referrals"))
    zero = F.lit(0).cast("long")
    j = (businesses.select(*DETAIL)
         .join(_subs(subscriptions, "status", "subscription_status"), "id", "left")
         .join(lp, "id", "left").join(refs, "id", "left"))
    total = F.coalesce("total_referrals", zero)
    return j.select(*DETAIL, "subscription_status", "last_payment_amount", "last_payment_date",
                    total.alias("total_referrals"),
                    F.when(F.col("subscription_status") == "active", total)
                    .otherwise(zero).alias("active_referrals"))


def invoice_rows(businesses: DataFrame, subscriptions: DataFrame,
                 payments: DataFrame, as_of) -> DataFrame:
    """The data of an invoice per business: status or 'Inactive', latest
    amount as dollars (0 when none), last payment date or 'N/A', address or
    'Not provided', and the invoice's own date, ``as_of``.  Sending it is not built."""
    lp = latest_payments(payments).select(F.col("business_id").alias("id"), "amount",
                                          F.col("created_at").alias("payment_date"))
    j = (businesses.select("id", "business_name", "email", "address")
         .join(_subs(subscriptions, "status", "subscription_status"), "id", "left")
         .join(lp, "id", "left"))
    return j.select(
        F.col("id").alias("business_id"), "business_name", "email",
        or_default(F.col("subscription_status"), INVOICE_NO_STATUS).alias("status_text"),
        usd(or_default_num(F.col("amount"), F.lit(0).cast("decimal(18,2)"))).alias("amount_text"),
        F.coalesce(us_date(F.col("payment_date")), F.lit(INVOICE_NO_PAYMENT)).alias("last_payment_text"),
        or_default(F.col("address"), INVOICE_NO_ADDRESS).alias("address_text"),
        us_date(as_of_lit(as_of)).alias("invoice_date_text"))


def subscription_status(businesses: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The subscription card per business, flattened.  ``trial_ends_at``
    is trial start + 14 days (X12: the column is read, not dropped)."""
    s = current_subscriptions(subscriptions, "status", "stripe_subscription_id", "current_period_end", "card_last4", "card_brand").select(
        F.col("business_id").alias("id"), F.col("status").alias("s_status"), "stripe_subscription_id", "current_period_end", "card_last4", "card_brand")
    j = businesses.select("id", "trial_reviews_remaining", "trial_started_at",
                          "total_referral_earnings").join(s, "id", "left")
    return j.select(
        F.col("id").alias("business_id"),
        or_default(F.col("s_status"), "trial").alias("status"),
        F.coalesce(F.col("s_status") == "active", F.lit(False)).alias("is_subscribed"),
        or_default_num(F.col("trial_reviews_remaining"), F.lit(0)).alias("trial_reviews_left"),
        (F.col("trial_started_at") + F.make_dt_interval(F.lit(TRIAL_DAYS))).alias("trial_ends_at"),
        F.col("current_period_end").alias("subscription_ends_at"),
        money_out(or_default_num(F.col("total_referral_earnings"),
                                 F.lit(0).cast("decimal(18,2)"))).alias("total_referral_earnings"),
        or_default(F.col("card_last4"), F.lit(None).cast("string")).alias("card_last4"),
        or_default(F.col("card_brand"), F.lit(None).cast("string")).alias("card_brand"),
        card_label(F.col("card_brand"), F.col("card_last4")).alias("card_display_name"))


def account_flags(businesses: DataFrame) -> DataFrame:
    """The account flags the request gates read (admin NULL = not admin)."""
    return businesses.select(
        "id", "email", "business_name",
        F.coalesce("is_salesperson", F.lit(False)).alias("is_salesperson"),
        F.coalesce("is_admin", F.lit(False)).alias("is_admin"),
        "subscription_status",
        F.coalesce("onboarding_completed", F.lit(False)).alias("onboarding_completed"))


def subscription_access(businesses: DataFrame, subscriptions: DataFrame, as_of) -> DataFrame:
    """D3: access per business: active; or cancelling with period end strictly
    after ``as_of``; or trial with quota > 0 (NULL quota = none); else denied."""
    j = businesses.select("id", "subscription_status", "trial_reviews_remaining") \
        .join(_subs(subscriptions, "current_period_end"), "id", "left")
    st, cpe, q = F.col("subscription_status"), F.col("current_period_end"), F.col("trial_reviews_remaining")
    reason = (F.when(st == "active", "paid")
              .when((st == "cancelling") & cpe.isNotNull() & (cpe > as_of_lit(as_of)), "paid_until_period_end")
              .when((st == "trial") & F.coalesce(q > 0, F.lit(False)), "trial")
              .otherwise("denied"))
    return j.select(F.col("id").alias("business_id"), (reason != "denied").alias("access"),
                    reason.alias("reason"))


def review_quota(businesses: DataFrame, subscriptions: DataFrame, attempts: DataFrame, **slicing):
    """D4 + M15: a batch of review attempts against the trial quota.

    Subscribed (active / cancelling) businesses are unlimited.  Otherwise the
    attempts of a business, in (attempted_at, attempt_id) order, pass while
    their rank is within the quota; a NULL or non-positive quota blocks (X19).
    Attempts for unknown businesses are ``unknown``.  Returns ``(decisions,
    balances)``; balances hold the new quota, max(q - passed, 0), for limited
    businesses with attempts.  ``slicing`` (slices, least, width) cuts a hot
    business's attempts as in ``running_count``.
    """
    acct = businesses.select(F.col("id").alias("business_id"), "trial_reviews_remaining") \
        .join(current_subscriptions(subscriptions, "status"),
              "business_id", "left")
    ranked = rank_in_key(attempts.select("attempt_id", "business_id", "attempted_at"),
                         "business_id", ["attempted_at", "attempt_id"], "rank", **slicing)
    j = ranked.join(acct.withColumn("__known", F.lit(True)), "business_id", "left")
    q = F.coalesce(F.col("trial_reviews_remaining"), F.lit(0))
    unlimited = F.col("status").isin("active", "cancelling")
    reason = (F.when(F.col("__known").isNull(), "unknown")
              .when(F.coalesce(unlimited, F.lit(False)), "subscribed")
              .when(F.col("rank") <= q, "trial")
              .otherwise("limit_reached"))
    decisions = j.select("attempt_id", "business_id", "rank",
                         reason.isin("subscribed", "trial").alias("allowed"), reason.alias("reason"))
    used = decisions.where(F.col("reason") == "trial").groupBy("business_id").agg(
        F.count(F.lit(1)).alias("passed"))
    limited = (acct.where(~F.coalesce(F.col("status").isin("active", "cancelling"), F.lit(False)))
               .join(attempts.select("business_id").distinct(), "business_id", "left_semi")
               .join(used, "business_id", "left"))
    passed = F.coalesce(F.col("passed"), F.lit(0).cast("long"))
    balances = limited.select(
        "business_id", F.col("trial_reviews_remaining").alias("old_quota"),
        passed.alias("passed"),
        F.when(F.col("trial_reviews_remaining").isNull(), F.lit(None).cast("int"))
        .otherwise(F.greatest(F.col("trial_reviews_remaining") - passed, F.lit(0)).cast("int"))
        .alias("new_quota"))
    return decisions, balances


def token_status(tokens: DataFrame, as_of) -> DataFrame:
    """Token state at ``as_of``: expired when ``as_of`` is strictly later
    than expires_at, else valid; kind is verify (email) or reset."""
    state = F.when(as_of_lit(as_of) > F.col("expires_at"), "expired").otherwise("valid")
    kind = F.when(F.col("type") == "email", "verify").when(
        F.col("type") == "password_reset", "reset").otherwise("unknown")
    return tokens.select("token", "business_id", "type", kind.alias("kind"), state.alias("state"))


def check_tokens(presented: DataFrame, tokens: DataFrame, as_of) -> DataFrame:
    """D8 for tokens that requests present with an expected type: ``unknown``
    (not stored), ``wrong_type``, ``expired`` or ``valid``, the first that
    applies.  A token stored more than once counts with its latest expiry."""
    stored = tokens.where(F.col("token").isNotNull()).groupBy("token").agg(
        F.max(F.struct("expires_at", F.col("type").alias("stored_type"), F.lit(1).alias("known"))).alias("t"))
    j = presented.join(stored.select("token", "t.*"), "token", "left")
    state = (F.when(F.col("known").isNull(), "unknown")
             .when(~F.col("stored_type").eqNullSafe(F.col("type")), "wrong_type")
             .when(as_of_lit(as_of) > F.col("expires_at"), "expired").otherwise("valid"))
    return j.select("request_id", "token", "type", state.alias("state"))


def token_funnel(tokens: DataFrame, as_of) -> DataFrame:
    """D8 as a report: tokens per (type, state)."""
    return distinct_ids(token_status(tokens, as_of), ["type", "state"], "business_id", "businesses",
                        {"tokens": F.count(F.lit(1))}).select("type", "state", "tokens", "businesses")


def rows_named(rows: DataFrame, batch: DataFrame, col: str) -> DataFrame:
    """The ``rows`` whose ``col`` occurs in ``batch``: a semi join before any
    aggregate, so that of a large table only what a batch asks for is shuffled
    (a small batch is broadcast once its size is measured; for large ones the
    engine puts its own runtime filter before the shuffle)."""
    return rows.join(batch.select(col).where(F.col(col).isNotNull()).distinct(), col, "left_semi")


def referral_code_owners(businesses: DataFrame, batch: DataFrame | None = None) -> DataFrame:
    """Code -> owner; a code held by several businesses maps to the lowest id.
    With ``batch``, only the codes that occur in its ``referral_code``."""
    coded = businesses.select("id", "referral_code").where(F.col("referral_code").isNotNull())
    return earliest_by_key(coded if batch is None else rows_named(coded, batch, "referral_code"),
                           ["referral_code"], ["id"], ["referral_code", "id"]) \
        .select("referral_code", F.col("id").alias("referrer_id"))


def attribute_referrals(signups: DataFrame, businesses: DataFrame) -> DataFrame:
    """Each signup's referral code to the referrer id; unknown code -> NULL."""
    return signups.select("signup_id", "referral_code").join(
        referral_code_owners(businesses, signups), "referral_code", "left")


def ingest_signups(businesses: DataFrame, signups: DataFrame, referrals: DataFrame):
    """Sign-up batch.  The first signup per e-mail in the batch (by
    created_at, signup_id) is a candidate; candidates whose e-mail exists are
    rejected.  Accepted rows become ``pending`` businesses and a referral row
    when the code resolves (D9); their ids are the signup ids above the largest
    stored id of the table.  Returns ``(decisions,
    new_businesses, new_referrals)``; no password is read."""
    first = earliest_by_key(signups, ["email"], ["created_at", "signup_id"],
                            ["email", "signup_id"]).select(
        "email", F.col("signup_id").alias("__first"))
    existing = rows_named(businesses.select("email"), signups, "email").distinct().withColumn("__exists", F.lit(True))
    d = (signups.join(first, "email", "left").join(existing, "email", "left")
         .join(referral_code_owners(businesses, signups), "referral_code", "left"))
    reason = (F.when(F.col("email").isNull(), "missing_email")
              .when(F.col("__first") != F.col("signup_id"), "duplicate_in_batch")
              .when(F.col("__exists").isNotNull(), "email_exists")
              .otherwise("accepted"))
    decisions = d.select("signup_id", "email", (reason == "accepted").alias("accepted"),
                         reason.alias("reason"),
                         F.when(reason == "accepted", F.col("referrer_id")).alias("referrer_id"))
    acc = d.where(reason == "accepted")
    new_id = above_max(businesses, F.col("signup_id"))
    new_b = acc.select(
        *[(new_id if c == "id" else
           F.lit("pending") if c == "subscription_status" else
           F.coalesce(F.col("is_salesperson"), F.lit(False)) if c == "is_salesperson" else
           F.lit(False) if c in ("onboarding_completed", "email_verified") else
           F.col(c) if c in ("business_name", "owner_name", "email", "phone", "address",
                             "google_review_link", "created_at") else
           F.lit(None)).cast(businesses.schema[c].dataType).alias(c)
          for c in businesses.columns])
    new_r = acc.where(F.col("referrer_id").isNotNull()).select(
        above_max(referrals, F.col("signup_id")).alias("id"), "referrer_id",
        new_id.alias("referred_business_id"), F.lit("pending").alias("status"),
        F.lit(False).alias("commission_paid"), F.lit(None).cast("decimal(18,2)").alias("commission_amount"),
        "created_at")
    return decisions, new_b, new_r


# ------------------------------------------------------------ keyed account patches
def suspend(subscriptions: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """M5: every subscription row of a requested business becomes suspended."""
    p = requests.select("business_id").distinct()
    return apply_patch(subscriptions, p, ["business_id"],
                       {"status": F.lit("suspended"), "updated_at": as_of_lit(as_of)},
                       patch_cols=[], flag="changed")


def apply_cancellations(businesses: DataFrame, subscriptions: DataFrame, requests: DataFrame,
                        as_of):
    """Cancel requests: subscription rows of the business become
    ``cancelling`` with cancelled_at = ``as_of`` (always overwritten here; the
    billing fold keeps the first) and the business status follows.  Only
    businesses that have a provider subscription id are processed (the
    reference answers 404 otherwise).  Returns ``(businesses, subscriptions)``."""
    has_sub = subscriptions.where(F.col("stripe_subscription_id").isNotNull()) \
        .select("business_id").distinct()
    p = requests.select("business_id").distinct().join(has_sub, "business_id", "left_semi")
    s = apply_patch(subscriptions, p, ["business_id"],
                    {"status": F.lit("cancelling"), "cancelled_at": as_of_lit(as_of)},
                    patch_cols=[], flag="changed")
    b = apply_patch(businesses, p.select(F.col("business_id").alias("id")), ["id"],
                    {"subscription_status": F.lit("cancelling")}, patch_cols=[], flag="changed")
    return b, s


def start_trials(businesses: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """Trial start: quota 10 and trial_started_at = ``as_of``."""
    p = requests.select(F.col("business_id").alias("id")).distinct()
    return apply_patch(businesses, p, ["id"],
                       {"trial_reviews_remaining": F.lit(TRIAL_QUOTA),
                        "trial_started_at": as_of_lit(as_of)}, patch_cols=[], flag="changed")


def patch_profiles(businesses: DataFrame, patches: DataFrame, as_of,
                   mark_onboarded: bool = True) -> DataFrame:
    """Profile patch; an absent field overwrites with NULL, as the
    reference's UPDATE does; the last patch per business wins."""
    fields = ["business_name", "owner_name", "phone", "address", "google_review_link"]
    p = patches.select(F.col("business_id").alias("id"), *fields, "requested_at")
    sets = {f: f for f in fields}
    sets["updated_at"] = as_of_lit(as_of)
    if mark_onboarded:
        sets["onboarding_completed"] = F.lit(True)
    return apply_patch(businesses, p, ["id"], sets, order_col="requested_at",
                       patch_cols=[*fields, "requested_at"], flag="changed")


def complete_onboarding(businesses: DataFrame, subscriptions: DataFrame, requests: DataFrame,
                        as_of):
    """Onboarding completes and an ``active`` subscription row is added,
    payment method defaulting to credit_card (JS ``||``: '' counts as absent).
    The new row's id lies above all stored ones, so it is the business's
    current subscription from then on.  Returns
    ``(businesses, new_subscription_rows)``."""
    last = latest_by_key(requests, ["business_id"], [Desc("requested_at", nulls_first=False)],
                         ["business_id", "payment_method", "requested_at"])
    b = apply_patch(businesses, last.select(F.col("business_id").alias("id")), ["id"],
                    {"onboarding_completed": F.lit(True)}, patch_cols=[], flag="changed")
    rows = last.select(*[
        (above_max(subscriptions, F.col("business_id")) if c == "id" else
         F.col("business_id") if c == "business_id" else
         or_default(F.col("payment_method"), DEFAULT_PAYMENT_METHOD) if c == "payment_method" else
         F.lit("active") if c == "status" else
         as_of_lit(as_of) if c in ("created_at", "updated_at") else
         F.lit(None)).cast(subscriptions.schema[c].dataType).alias(c)
        for c in subscriptions.columns])
    return b, rows
