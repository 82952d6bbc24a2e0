"""FIXTURES.md §3: hand-worked cases for the traps that change results."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from helpers_business import mk, ts
from ledgerlark.functions.scalar import card_label, next_month_start
from ledgerlark.operators import accounts as ac
from ledgerlark.operators import bank, coupons as cp, finance, referrals as rf, reviews as rv


def test_x4_fanout_leaderboard(spark):
    b = mk(spark, "businesses", [{"id": 1, "business_name": "S", "is_salesperson": True},
                                 {"id": 2}, {"id": 3}])
    r = mk(spark, "referrals", [{"id": 10, "referrer_id": 1, "referred_business_id": 2},
                                {"id": 11, "referrer_id": 1, "referred_business_id": 3}])
    s = mk(spark, "subscriptions", [])
    e = mk(spark, "referral_earnings", [{"id": 1, "seller_id": 1, "amount": D("7")},
                                        {"id": 2, "seller_id": 1, "amount": D("3")}])
    assert rf.salespeople_leaderboard(b, r, s, e).first()["total_commission"] == 10.0
    assert rf.salespeople_leaderboard(b, r, s, e, "as_written").first()["total_commission"] == 20.0


def test_x4_revenue(spark):
    p = mk(spark, "payments", [{"id": 1, "business_id": 1, "amount": D("100"),
                                "created_at": ts("2020-01-05 10:00:00")}])
    c = mk(spark, "commissions", [{"payment_id": 1, "amount": D("5")}, {"payment_id": 1, "amount": D("5")}])
    d = finance.daily_revenue(p, c, "2020-01-01", "2020-01-31").first()
    assert (d["revenue"], d["net_revenue"]) == (100.0, 90.0)
    d = finance.daily_revenue(p, c, "2020-01-01", "2020-01-31", "as_written").first()
    assert (d["revenue"], d["net_revenue"]) == (200.0, 190.0)


def test_x8_status_rules(spark):
    df = spark.createDataFrame([("active", False)], "s string, o boolean")
    row = df.select(rf.referral_status_active_first(F.col("s"), F.col("o")).alias("a"),
                    rf.referral_status_onboarding_first(F.col("s"), F.col("o")).alias("b")).first()
    assert (row["a"], row["b"]) == ("active", "pending_onboarding")


def test_x9_x10_latest_payment(spark):
    p = mk(spark, "payments", [{"id": 1, "business_id": 7, "created_at": ts("2020-01-01 00:00:00")},
                               {"id": 2, "business_id": 7, "created_at": None},
                               {"id": 5, "business_id": 8, "created_at": ts("2020-01-01 00:00:00")},
                               {"id": 9, "business_id": 8, "created_at": ts("2020-01-01 00:00:00")}])
    got = {r["business_id"]: r for r in ac.latest_payments(p).collect()}
    assert got[7]["created_at"] is None
    lp = ac.latest_payments(p.withColumn("amount", F.col("id").cast("decimal(18,2)")))
    got = {r["business_id"]: r["amount"] for r in lp.collect()}
    assert got[7] == D("2") and got[8] == D("9")


def test_x13_commissions_report_inner(spark):
    b = mk(spark, "businesses", [{"id": 1, "business_name": "S", "is_salesperson": True}, {"id": 2}])
    r = mk(spark, "referrals", [{"id": 10, "referrer_id": 1, "referred_business_id": 2}])
    c = mk(spark, "commissions", [{"referral_id": 10, "amount": D("1"), "created_at": ts("2019-01-01 00:00:00")}])
    assert finance.commissions_report(b, r, c, "2020-01-01", "2020-12-31").count() == 0


def test_x19_null_quota_blocks(spark):
    b = mk(spark, "businesses", [{"id": 1, "trial_reviews_remaining": None}])
    s = mk(spark, "subscriptions", [])
    a = mk(spark, "review_attempts", [{"attempt_id": 1, "business_id": 1, "attempted_at": ts("2020-01-01 00:00:00")}])
    d, bal = ac.review_quota(b, s, a)
    assert d.first()["reason"] == "limit_reached"


def test_x21_monthly_earnings_rerun(spark):
    r = mk(spark, "referrals", [{"id": 1, "referrer_id": 9, "referred_business_id": 2, "status": "active"}])
    s = mk(spark, "subscriptions", [{"id": 1, "business_id": 2, "amount": 1000}])
    e = mk(spark, "referral_earnings", [])
    first = rf.monthly_earnings(r, s, e, "2020-03-01", "2020-03-15")
    assert first.count() == 1 and first.first()["amount"] == D("200.00")
    e2 = e.unionByName(first.select(*[F.col(c) if c in first.columns else F.lit(None).alias(c)
                                      for c in e.columns]), allowMissingColumns=False)
    assert rf.monthly_earnings(r, s, e2, "2020-03-01", "2020-03-15").count() == 0
    assert rf.monthly_earnings(r, s, e2, "2020-03-01", "2020-03-15", as_written=True).count() == 1


def test_r1_empty_and_rounding(spark):
    b = mk(spark, "businesses", [{"id": 1}, {"id": 2}])
    rv_ = mk(spark, "reviews", [{"id": i, "business_id": 1, "rating": x} for i, x in enumerate([4, 5, 4, 4])])
    got = {r["business_id"]: r for r in rv.review_stats(rv_, b).collect()}
    assert got[1]["average_rating"] == 4.3 and got[1]["positive"] == 4
    assert (got[2]["total"], got[2]["positive"], got[2]["negative"], got[2]["average_rating"]) == (0, 0, 0, None)


def test_r15_no_referrals(spark):
    b = mk(spark, "businesses", [{"id": 1}])
    out = rf.earnings_stats(b, mk(spark, "referrals", []), mk(spark, "referral_earnings", []),
                            mk(spark, "subscriptions", [])).first()
    assert out["conversion_rate"] is None and out["total_earnings"] == 0.0 and out["successful_referrals"] == 0


def test_r5_d3_period_end_equals_now(spark):
    now = "2020-06-01 00:00:00"
    b = mk(spark, "businesses", [{"id": 1, "subscription_status": "cancelling"}])
    s = mk(spark, "subscriptions", [{"id": 1, "business_id": 1, "current_period_end": ts(now)}])
    assert ac.public_listing(b, s, now).count() == 1
    assert ac.subscription_access(b, s, now).first()["access"] is False


def test_r17_gap_month(spark):
    p = mk(spark, "payments", [{"id": 1, "business_id": 1, "amount": D("5"), "created_at": ts("2020-05-10 00:00:00")}])
    e = mk(spark, "referral_earnings", [])
    rows = {r["month"].month: r["revenue"] for r in finance.monthly_financials(spark, p, e, "2020-06-15", 3).collect()}
    assert rows == {4: 0.0, 5: 5.0, 6: 0.0}


def test_r18_date_bound_excludes_noon(spark):
    p = mk(spark, "payments", [{"id": 1, "business_id": 1, "amount": D("5"), "created_at": ts("2020-01-31 12:00:00")}])
    c = mk(spark, "commissions", [])
    assert finance.daily_revenue(p, c, "2020-01-01", "2020-01-31").count() == 0


def _attempts(spark, rows):
    return mk(spark, "coupon_attempts", [
        {"attempt_id": str(i), "code": code, "business_id": bid, "attempted_at": ts(t)}
        for i, (code, bid, t) in enumerate(rows)])


def test_d5_trial_last_use(spark):
    c = mk(spark, "coupons", [{"id": 1, "code": "TRY", "type": "trial", "value": 7, "max_uses": 1}])
    red = mk(spark, "coupon_redemptions", [])
    a = _attempts(spark, [("try", 10, "2020-01-01 00:00:00"), ("TRY", 11, "2020-01-02 00:00:00")])
    got = {r["business_id"]: r["reason"] for r in cp.coupon_decisions(a, c, red).collect()}
    assert got == {10: "ok", 11: "max_uses"}


def test_d5_discount_not_recorded(spark):
    c = mk(spark, "coupons", [{"id": 1, "code": "OFF", "type": "discount", "value": 7, "max_uses": 2}])
    red = mk(spark, "coupon_redemptions", [{"coupon_id": 1, "business_id": 99}])
    a = _attempts(spark, [("OFF", 10, "2020-01-01 00:00:00"), ("OFF", 11, "2020-01-02 00:00:00")])
    d = cp.coupon_decisions(a, c, red)
    assert {r["reason"] for r in d.collect()} == {"ok"}
    b = mk(spark, "businesses", [{"id": 10}, {"id": 11}])
    _, red2, c2 = cp.redeem_trials(d, b, c, red, "2020-02-01")
    assert red2.count() == 1 and c2.first()["times_used"] == 1


def test_d5_repeat_spends_once(spark):
    c = mk(spark, "coupons", [{"id": 1, "code": "TRY", "type": "trial", "value": 7, "max_uses": 5}])
    red = mk(spark, "coupon_redemptions", [])
    a = _attempts(spark, [("TRY", 10, "2020-01-01 00:00:00"), ("TRY", 10, "2020-01-02 00:00:00")])
    d = cp.coupon_decisions(a, c, red)
    assert [r["reason"] for r in d.orderBy("attempted_at").collect()] == ["ok", "already_used"]
    b = mk(spark, "businesses", [{"id": 10}])
    b2, _, c2 = cp.redeem_trials(d, b, c, red, "2020-02-01 00:00:00")
    assert c2.first()["times_used"] == 1
    row = b2.first()
    assert row["subscription_status"] == "trial" and row["trial_ends_at"] == ts("2020-02-08 00:00:00")


def test_d6_trailing_newline(spark):
    ch = mk(spark, "bank_changes", [{"business_id": 1, "transit_number": "12345\n",
                                     "institution_number": "001", "account_number": "1234567"}])
    row = bank.validate_bank_details(ch).first()
    assert row["valid"] is False and row["error"] == "Transit number must be 5 digits"


def test_f12_f14(spark):
    df = spark.createDataFrame([("american express", "4242", ts("2024-12-31 15:00:00"))],
                               "brand string, last4 string, t timestamp")
    row = df.select(card_label(F.col("brand"), F.col("last4")).alias("l"),
                    next_month_start(F.col("t")).alias("n")).first()
    assert row["l"] == "American express ending in 4242"
    assert row["n"] == ts("2025-01-01 00:00:00")


def test_text_helpers(spark):
    from ledgerlark.functions.scalar import fixed2, keyed_code, keyed_id, us_date, usd
    df = spark.createDataFrame([(D("-1234.5"), ts("2001-07-04 10:00:00"), 42)],
                               "x decimal(18,2), t timestamp, i long")
    x, t, i = F.col("x"), F.col("t"), F.col("i")
    r = df.select(usd(x).alias("u"), fixed2(x).alias("f"), us_date(t).alias("d"),
                  keyed_id(i).alias("k"), keyed_code(i).alias("c")).first()
    assert (r["u"], r["f"], r["d"]) == ("-$1,234.50", "-1234.50", "7/4/2001")
    n, code = int(r["k"], 16) % 36 ** 8, ""                # base 36 of the key's 60 hash bits
    for _ in range(8):
        n, code = n // 36, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[n % 36] + code
    assert len(r["k"]) == 15 and r["c"] == code


def test_r20_r22_zero_rows(spark):
    b = mk(spark, "businesses", [{"id": 1, "is_salesperson": True}])
    r = mk(spark, "referrals", [])
    e = mk(spark, "referral_earnings", [])
    s = mk(spark, "subscriptions", [])
    row = rf.referral_totals(r, s, e, b).first()
    assert (row["referrer_id"], row["total_referrals"], row["total_earnings"]) == (1, 0, 0.0)
    row = rf.seller_totals(r, e, "2024-12-31 00:00:00", sellers=b).first()
    assert (row["total_referrals"], row["pending_earnings"]) == (0, 0.0)
    assert row["next_payout_date"] == ts("2025-01-01 00:00:00")


def test_m9_qr_upsert_rules(spark):
    from ledgerlark.operators import qr
    q = mk(spark, "qr_codes", [{"id": 1, "business_id": 1, "type": "table", "url_id": "keep", "scans": 7},
                               {"id": 2, "business_id": 2, "type": "table", "url_id": None, "scans": 3}])
    ch = mk(spark, "qr_changes", [
        {"change_id": 10, "business_id": 1, "type": "table", "url_id": "new1", "updated_at": ts("2024-01-02 00:00:00")},
        {"change_id": 11, "business_id": 2, "type": "table", "url_id": None, "updated_at": ts("2024-01-02 00:00:00")},
        {"change_id": 12, "business_id": 3, "type": "door", "url_id": "u3", "updated_at": ts("2024-01-02 00:00:00")}])
    got = {(r["business_id"], r["type"]): r for r in qr.upsert_qr_codes(q, ch, "2024-01-31 00:00:00").collect()}
    assert got[(1, "table")]["url_id"] == "keep" and got[(1, "table")]["scans"] == 7
    assert got[(2, "table")]["url_id"] is not None and len(got[(2, "table")]["url_id"]) == 15
    assert got[(3, "door")]["url_id"] == "u3" and got[(3, "door")]["scans"] == 0 and got[(3, "door")]["id"] == 14   # above the stored ids


def test_m10_invalid_changes_skipped(spark):
    bd = mk(spark, "bank_details", [{"business_id": 1, "transit_number": "11111", "bank_name": "old"}])
    ch = mk(spark, "bank_changes", [
        {"business_id": 1, "transit_number": "1234", "institution_number": "001", "account_number": "1234567",
         "bank_name": "bad", "changed_at": ts("2024-01-01 00:00:00")},
        {"business_id": 2, "transit_number": "12345", "institution_number": "001", "account_number": "1234567",
         "bank_name": "good", "changed_at": ts("2024-01-01 00:00:00")}])
    got = {r["business_id"]: r["bank_name"] for r in bank.upsert_bank_details(bd, ch, "2024-01-31").collect()}
    assert got == {1: "old", 2: "good"}


def test_m1_m3_referral_jobs(spark):
    r = mk(spark, "referrals", [
        {"id": 1, "referrer_id": 9, "referred_business_id": 2, "status": "pending"},
        {"id": 2, "referrer_id": 9, "referred_business_id": 3, "status": "pending"},
        {"id": 3, "referrer_id": 8, "referred_business_id": 2, "status": "active"}])
    b = mk(spark, "businesses", [{"id": 2, "onboarding_completed": True}, {"id": 3, "onboarding_completed": False}])
    got = {x["id"]: (x["status"], x["changed"]) for x in rf.activate_referrals(r, b).collect()}
    assert got == {1: ("active", True), 2: ("pending", False), 3: ("active", False)}
    p = mk(spark, "payments", [{"id": 5, "business_id": 2, "amount": D("100"), "created_at": ts("2020-03-09 00:00:00")}])
    r2 = rf.activate_referrals(r, b).drop("changed")
    e = rf.payment_earnings(p, r2).collect()
    assert len(e) == 1 and e[0]["referral_id"] == 1 and e[0]["amount"] == D("75.00")
    assert e[0]["month"] == ts("2020-03-01 00:00:00")


def test_m20_codes_kept_and_unique(spark):
    from ledgerlark.sources import load_tables
    from helpers_business import SF_SMALL
    t = load_tables(spark, SF_SMALL)
    codes = rf.fill_referral_codes(t.businesses, "https://x")
    # stored codes may be shared; a generated one is no other business's
    shared = rf.referral_code_collisions(codes).select("referral_code")
    assert codes.where("generated").join(shared, "referral_code").count() == 0
    kept = codes.where("NOT generated").join(t.businesses.select("id", F.col("referral_code").alias("old")), "id")
    assert kept.where("referral_code <> old").count() == 0


def test_r4_filter_branches(spark):
    r = mk(spark, "reviews", [{"id": i, "business_id": 1, "rating": x} for i, x in enumerate([1, 3, 4, 5])])
    assert rv.reviews_by_sentiment(r, "positive").count() == 2
    assert rv.reviews_by_sentiment(r, "negative").count() == 2
    assert rv.reviews_by_sentiment(r, "anything").count() == 4
    assert rv.reviews_by_sentiment(r, None).count() == 4


def test_d5_strict_checks_active_and_expiry(spark):
    c = mk(spark, "coupons", [
        {"id": 1, "code": "OFF", "type": "trial", "value": 7, "max_uses": 5, "is_active": False},
        {"id": 2, "code": "OLD", "type": "trial", "value": 7, "max_uses": 5, "is_active": True,
         "expires_at": ts("2020-01-01 00:00:00")},
        {"id": 3, "code": "OK", "type": "trial", "value": 7, "max_uses": 5, "is_active": True}])
    red = mk(spark, "coupon_redemptions", [])
    a = _attempts(spark, [("OFF", 10, "2020-02-01 00:00:00"), ("OLD", 10, "2020-02-01 00:00:00"),
                          ("OK", 10, "2020-02-01 00:00:00")])
    loose = {r["coupon_id"]: r["reason"] for r in cp.coupon_decisions(a, c, red).collect()}
    strict = {r["coupon_id"]: r["reason"] for r in cp.coupon_decisions(a, c, red, strict=True).collect()}
    assert loose == {1: "ok", 2: "ok", 3: "ok"}                  # as written: flags not checked (X17)
    assert strict == {1: "inactive", 2: "expired", 3: "ok"}


def test_x16_duplicate_subscriptions(spark):
    from ledgerlark.operators.subscriptions import current_subscriptions
    b = mk(spark, "businesses", [{"id": 1}])
    s = mk(spark, "subscriptions", [{"id": 4, "business_id": 1, "status": "cancelled"},
                                    {"id": 9, "business_id": 1, "status": "active"}])
    p = mk(spark, "payments", [{"id": 1, "business_id": 1, "amount": D("50")}])
    e = mk(spark, "referral_earnings", [])
    assert current_subscriptions(s).first()["id"] == 9
    agg = finance.financial_totals(b, s, p, e).first()
    raw = finance.financial_totals(b, s, p, e, "as_written").first()
    assert (agg["total_revenue"], agg["active_businesses"]) == (50.0, 1)
    assert raw["total_revenue"] == 100.0                  # each subscription row repeats the payment


def test_new_subscription_ids_pass_rows_without_a_business(spark):
    """A stored row without a business is nobody's current row, but its id is taken."""
    from ledgerlark.streaming.billing import fold_billing
    stored = mk(spark, "subscriptions", [{"id": 5, "business_id": 1}, {"id": 90, "business_id": None}])
    events = mk(spark, "billing_events", [{"event_id": "e1", "event_ts": ts("2024-01-01"), "business_id": 2,
                                           "type": "checkout.session.completed", "stripe_subscription_id": "s2"}])
    snap = {r["business_id"]: r["id"] for r in fold_billing(events, stored)[0].collect()}
    assert snap == {1: 5, 2: 92}
