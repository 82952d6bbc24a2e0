"""Plan shape: no cartesian products, pruned scans, pushed filters, group limits."""

import tempfile

from pyspark.sql import functions as F

import pytest

from helpers_business import SF_SMALL
from ledgerlark.operators import finance, reviews as rv
from ledgerlark.plans.registry import all_queries
from ledgerlark.sources import load_tables, read_domain_tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan(all_queries()[name].build(spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_profile_scan_reads_two_columns(spark):
    from ledgerlark.operators import accounts as ac
    p = plan(ac.business_profile(load_tables(spark, SF_SMALL).businesses))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in p


def test_top_n_uses_group_limit(spark):
    p = plan(rv.recent_reviews(load_tables(spark, SF_SMALL).reviews))
    assert "WindowGroupLimit" in p


def test_filters_reach_domain_parquet(spark):
    root = tempfile.mkdtemp(prefix="domain-")
    t = load_tables(spark, SF_SMALL)
    for name in ("payments", "commissions"):
        t[name].write.parquet(f"{root}/{name}")
    d = read_domain_tables(spark, root)
    p = plan(finance.daily_revenue(d.payments, d.commissions, "1998-01-01", "1998-06-30"))
    assert "PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual(created_at" in p
    assert "ReadSchema: struct<id:bigint,amount:decimal(18,2),created_at:timestamp>" in p


def test_bucketed_tables_join_without_shuffle(spark):
    from ledgerlark.operators import accounts as ac
    from ledgerlark.sources.layout import read_table, write_business_tables
    t = load_tables(spark, SF_SMALL)
    names = write_business_tables(t, ["businesses", "payments"], 4, prefix="bkt_")
    b, p = read_table(spark, names["businesses"]), read_table(spark, names["payments"])
    lp = ac.latest_payments(p)
    j = b.select("id", "business_name").join(lp, b["id"] == lp["business_id"])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # force the co-located path
    try:
        pl = plan(j)
        assert "SortMergeJoin" in pl and "Exchange" not in pl, pl
        assert j.count() == t.payments.select("business_id").distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_tenant_filter_pushed_and_equal(spark):
    from ledgerlark.operators.common import for_tenants
    root = tempfile.mkdtemp(prefix="domain-")
    t = load_tables(spark, SF_SMALL)
    for name in ("reviews", "businesses"):
        t[name].write.parquet(f"{root}/{name}")
    d = read_domain_tables(spark, root)
    ids = [3, 5, 8]
    one = rv.review_stats(for_tenants(d.reviews, "business_id", ids), for_tenants(d.businesses, "id", ids))
    p = plan(one)
    assert "PushedFilters: [In(business_id, [3,5,8])]" in p or "In(business_id" in p, p
    every = rv.review_stats(d.reviews, d.businesses).where(F.col("business_id").isin(ids))
    assert one.exceptAll(every).count() == 0 and every.exceptAll(one).count() == 0


def test_tenant_filter_by_frame(spark):
    from ledgerlark.operators.common import for_tenants
    t = load_tables(spark, SF_SMALL)
    ids = spark.createDataFrame([(3,), (5,), (8,), (5,)], "bid long")
    a = for_tenants(t.reviews, "business_id", ids)
    b = for_tenants(t.reviews, "business_id", [3, 5, 8])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 0


def test_public_listing_reads_three_subscription_columns(spark):
    import re
    import tempfile

    from ledgerlark.operators import accounts as ac
    t, path = load_tables(spark, SF_SMALL), tempfile.mkdtemp(prefix="subs-") + "/s"
    t.subscriptions.write.parquet(path)
    plan = ac.public_listing(t.businesses, spark.read.parquet(path), "2001-08-01 00:00:00")._jdf.queryExecution().toString()
    schemas = [m for m in re.findall(r"ReadSchema: struct<([^>]*)>", plan) if "current_period_end" in m]
    assert schemas and all({c.split(":")[0] for c in m.split(",")} == {"id", "business_id", "current_period_end"} for m in schemas)
