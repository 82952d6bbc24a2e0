"""Properties: exact ranks under a hot key, rerun/idempotence, totals, input order."""

from decimal import Decimal as D

from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers_business import SF_SMALL, mk, ts
from ledgerlark.operators import coupons as cp, finance, qr
from ledgerlark.operators.common import rank_in_key, running_count
from ledgerlark.sources import load_tables


def test_running_count_hot_key_matches_window(spark):
    # key 0 holds 40% of the rows; ties on t are broken by id
    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 5 < 2, F.lit(0)).otherwise(F.col("id") % 97).alias("k"),
        (F.col("id") % 13).alias("t"), F.col("id"),
        (F.col("id") % 3 == 0).alias("f"))
    got = running_count(df, "k", ["t", "id"], "n", flag=F.col("f"), width=3)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("n", F.coalesce(F.sum(F.col("f").cast("long")).over(w), F.lit(0)))
    assert got.count() == 5000
    assert got.select("id", "n").exceptAll(want.select("id", "n")).count() == 0
    ranks = rank_in_key(df, "k", ["t", "id"], "r")
    want_r = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")))
    assert ranks.select("id", "r").exceptAll(want_r.select("id", "r")).count() == 0


def test_equal_slices_split_a_burst(spark):
    """One key holds most rows, all within one hour and most within a second:
    every slice stays under twice the mean, and the counts are those of a window."""
    from ledgerlark.operators.common import equal_slices
    start = F.unix_seconds(F.lit(ts("2020-01-01 00:00:00")))
    df = spark.range(0, 20_000).select(
        F.when(F.col("id") % 10 < 9, F.lit(7)).otherwise(F.col("id") % 50).alias("k"), F.col("id"),
        F.timestamp_micros((start * 1_000_000 + F.when(F.col("id") % 3 == 0, F.col("id") * 150_000)
                            .otherwise(F.col("id") * 50)).cast("long")).alias("t"), (F.col("id") % 3 == 0).alias("f"))
    sizes = [r["count"] for r in equal_slices(df, "k", "t", 16, 1000, "e").where("k = 7").groupBy("e").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    got = running_count(df, "k", ["t", "id"], "n", flag=F.col("f"), slices=16, least=1000)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("n", F.coalesce(F.sum(F.col("f").cast("long")).over(w), F.lit(0)))
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == 20_000
    # rows of one value, null keys and null times
    odd = spark.createDataFrame([(1, 5, i) for i in range(40)] + [(None, i, 100 + i) for i in range(40)] + [(1, None, 200)],
                                "k long, t long, id long")
    ranks = rank_in_key(odd, "k", ["t", "id"], "r", slices=4, least=10, width=1000)
    want = odd.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.col("t").asc_nulls_last(), "id")))
    assert ranks.exceptAll(want.withColumn("r", F.col("r").cast("long"))).count() == 0 and ranks.count() == 81


def test_distinct_ids_are_exact(spark):
    from ledgerlark.operators.common import distinct_ids
    df = spark.range(0, 90_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") % 50_000 - 100).alias("v"))
    got = distinct_ids(df, ["k"], "v", "ids", {"n": F.count(F.lit(1))})
    want = df.groupBy("k").agg(F.count_distinct("v").alias("ids"), F.count(F.lit(1)).alias("n"))
    assert got.exceptAll(want).count() == 0 and got.count() == 3
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


def test_running_count_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 2, 2), (5, 1, 3)], "k long, t long, id long")
    got = {r["id"]: r["n"] for r in rank_in_key(df, "k", ["t", "id"], "n").collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_upsert_twice_equals_once(spark):
    t = load_tables(spark, SF_SMALL)
    once = qr.upsert_qr_codes(t.qr_codes, t.qr_changes, "2024-01-31 00:00:00")
    twice = qr.upsert_qr_codes(once, t.qr_changes, "2024-01-31 00:00:00")
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_pre_aggregated_total_is_plain_sum(spark):
    t = load_tables(spark, SF_SMALL)
    tot = finance.financial_totals(t.businesses, t.subscriptions, t.payments, t.referral_earnings).first()
    plain = t.payments.join(t.businesses.select(F.col("id").alias("business_id")), "business_id", "left_semi") \
        .agg(F.sum("amount")).first()[0]
    assert tot["total_revenue"] == round(float(plain), 2)


def test_coupon_decisions_ignore_input_order(spark):
    t = load_tables(spark, SF_SMALL)
    a = t.coupon_attempts
    d1 = cp.coupon_decisions(a, t.coupons, t.coupon_redemptions).select("attempt_id", "reason")
    shuffled = a.orderBy(F.rand(3)).repartition(7)
    d2 = cp.coupon_decisions(shuffled, t.coupons, t.coupon_redemptions).select("attempt_id", "reason")
    assert d1.exceptAll(d2).count() == 0 and d2.exceptAll(d1).count() == 0


def test_discount_batch_hot_coupon(spark):
    # one trial coupon takes every attempt; exactly max_uses - u0 distinct businesses succeed
    c = mk(spark, "coupons", [{"id": 1, "code": "HOT", "type": "trial", "value": 3, "max_uses": 50}])
    red = mk(spark, "coupon_redemptions", [{"coupon_id": 1, "business_id": i} for i in range(10)])
    a = spark.range(0, 3000).select(
        F.col("id").cast("string").alias("attempt_id"), F.lit("hot").alias("code"),
        (F.col("id") % 400).alias("business_id"),
        (F.lit(ts("2020-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("attempted_at"))
    d = cp.coupon_decisions(a, c, red)
    ok = d.where("reason = 'ok'")
    assert ok.count() == 40
    assert ok.select("business_id").distinct().count() == 40
    assert d.where("reason = 'ok'").agg(F.max("attempted_at")).first()[0] < \
        d.where("reason = 'max_uses'").agg(F.min("attempted_at")).first()[0]


def test_left_join_fact_equals_left_join(spark):
    from ledgerlark.operators.common import left_join_fact
    left = spark.range(0, 50).select(F.col("id").alias("k"), (F.col("id") * 10).alias("lv"))
    right = spark.range(0, 4000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 40).alias("k"),   # key 7 is hot
        F.col("id").alias("rv"))
    got = left_join_fact(left, right, ["k"])
    want = left.join(right, ["k"], "left")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.where("rv IS NULL").count() == 10          # keys 40..49 have no partner


def test_running_count_keeps_values_and_keys(spark):
    big = 2 ** 53
    rows = [(big, ts("2020-01-01 00:00:00"), 1, big + 1), (big + 1, ts("2020-01-01 00:00:00"), 2, None),
            (None, None, 3, big + 3), (None, ts("2020-01-01 02:00:00"), 4, big + 5), (big, ts("2020-01-01 00:59:59"), 5, 0)]
    df = spark.createDataFrame(rows, "k long, t timestamp, id long, v long")
    got = {r["id"]: (r["k"], r["v"], r["r"]) for r in rank_in_key(df, "k", ["t", "id"], "r").collect()}
    assert got == {1: (big, big + 1, 1), 5: (big, 0, 2), 2: (big + 1, None, 1), 4: (None, big + 5, 1), 3: (None, big + 3, 2)}


def test_new_subscription_row_is_the_current_one(spark):
    from ledgerlark.operators import accounts as ac
    from ledgerlark.operators.subscriptions import current_subscriptions
    b = mk(spark, "businesses", [{"id": 5}])
    s = mk(spark, "subscriptions", [{"id": 50, "business_id": 5, "status": "cancelled"}, {"id": 60, "business_id": 6}])
    q = mk(spark, "onboarding_requests", [{"business_id": 5, "requested_at": ts("2020-01-01 00:00:00")}])
    _, rows = ac.complete_onboarding(b, s, q, "2020-01-02 00:00:00")
    now = current_subscriptions(s.unionByName(rows), "id", "status").where("business_id = 5").first()
    assert (now["id"], now["status"]) == (65, "active")


def test_referral_codes_do_not_clash(spark):
    from ledgerlark.operators import referrals as rf
    b = spark.range(1_000_000).select("id", F.lit(None).cast("string").alias("referral_code"))
    codes = rf.fill_referral_codes(b, "x")
    assert codes.where("referral_code IS NULL OR length(referral_code) <> 8").count() == 0
    assert rf.referral_code_collisions(codes).count() == 0


def test_rate_keeps_its_digits(spark):
    from ledgerlark.operators import referrals as rf
    r = mk(spark, "referrals", [{"id": 1, "referrer_id": 2, "referred_business_id": 3, "status": "active"}])
    s = mk(spark, "subscriptions", [{"id": 1, "business_id": 3, "amount": 1000}])
    out = rf.monthly_earnings(r, s, mk(spark, "referral_earnings", []), "2020-01-01", "2020-01-01 00:00:00", rate=0.125)
    assert out.first()["amount"] == D("125.00")


def test_reports_are_ordered(spark):
    from ledgerlark.operators import referrals as rf
    t = load_tables(spark, SF_SMALL)

    def falling(rows, col, tenant=None):
        key = [(r[tenant] if tenant else 0, r[col] is not None, -(r[col].timestamp() if hasattr(r[col], "timestamp") else r[col] or 0)) for r in rows]
        assert key == sorted(key)
    falling(rf.salespeople_leaderboard(t.businesses, t.referrals, t.subscriptions, t.referral_earnings).collect(), "total_commission")
    falling(finance.commissions_report(t.businesses, t.referrals, t.commissions, "1998-01-01", "1998-06-30").collect(), "total_commission")
    for rows, col, tenant in [
            (rf.salesperson_referrals(t.referrals, t.businesses, t.subscriptions, t.referral_earnings), "referral_date", "referrer_id"),
            (rf.salesperson_payouts(t.referral_earnings, t.businesses), "payment_date", "seller_id"),
            (rf.referral_rows(t.referrals, t.businesses, t.subscriptions, t.referral_earnings), "created_at", "referrer_id"),
            (rf.seller_referrals(t.referrals, t.businesses, t.subscriptions, t.referral_earnings), "join_date", "referrer_id"),
            (rf.seller_payouts(t.referral_earnings, t.referrals, t.businesses), "date", "referrer_id"),
            (rf.salesperson_referral_payments(t.referrals, t.businesses, t.payments), "join_date", "referrer_id")]:
        falling(rows.collect(), col, tenant)
    months = [r["month"] for r in finance.monthly_financials(spark, t.payments, t.referral_earnings, "1998-06-30 00:00:00").collect()]
    days = [r["date"] for r in finance.daily_revenue(t.payments, t.commissions, "1998-01-01", "1998-06-30").collect()]
    assert months == sorted(months) and days == sorted(days)


def test_left_join_fact_slices_hot_keys_only(spark):
    """Hot keys cut into slices give the plain join's rows, whether their left rows repeat or lack partners."""
    from ledgerlark.operators.common import heavy_keys, left_join_fact
    left = spark.createDataFrame([(1, "a", 7), (1, "b", 7), (2, "c", 7), (3, "d", 7), (None, "e", 7), (2, "f", None)],
                                 "k int, name string, m int")
    rows = [(1, 7, i, None if i % 3 else "x") for i in range(900)] + [(2, 7, 1, "y"), (2, 7, 1, "y"), (None, 7, 5, "z"), (9, 7, 5, "z")]
    right = spark.createDataFrame(rows, "k int, m int, v int, t string")
    for on in (["k"], ["k", "m"]):
        r = right if len(on) == 2 else right.drop("m")
        got, want = left_join_fact(left, r, on, least=100), left.join(r, on, "left")
        assert got.columns == want.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        slices = {x["k"]: x["n"] for x in r.select("k", heavy_keys(r, on, 100).alias("n")).distinct().collect()}
        assert slices[1] == 9 and slices[2] == slices[9] == 1
    assert left_join_fact(left, right.limit(0), ["k", "m"]).count() == 6
    p = left_join_fact(left, right, ["k", "m"])._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("Join ") == 1


def test_no_hot_task_in_left_join_fact(spark):
    """A third of all rows under one key: no partition of the join holds more than twice its share."""
    from ledgerlark.operators.common import left_join_fact
    left = spark.range(2000).select(F.col("id").alias("k"))
    right = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 1500).alias("k"),
                                       F.col("id").alias("v"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled",
                                          "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        j = left_join_fact(left, right, ["k"], least=500)
        sizes = [r["count"] for r in j.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    # two thirds of the left keys below 1500 have partners
    assert sum(sizes) == 60_000 + 1000 and max(sizes) <= 2 * sum(sizes) / 8


def test_signups_shuffle_only_what_the_batch_names(spark):
    from ledgerlark.operators import accounts as ac
    from ledgerlark.sources import load_tables
    t = load_tables(spark, SF_SMALL)
    few = t.signups.limit(5)
    d = ac.attribute_referrals(few, t.businesses)
    d.collect()
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan
    want = few.select("signup_id", "referral_code").join(ac.referral_code_owners(t.businesses), "referral_code", "left")
    assert d.exceptAll(want).count() == 0 and want.exceptAll(d).count() == 0
