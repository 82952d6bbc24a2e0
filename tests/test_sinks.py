"""Sinks: partitioned append (S3), snapshot write (S4), nested JSON (S5),
and the stream's foreachBatch snapshot writer."""

import json
import tempfile

from pyspark.sql import functions as F

from helpers_business import SF_SMALL, mk, ts
from ledgerlark.operators import accounts as ac
from ledgerlark.sources import load_tables, read_domain_tables
from ledgerlark.sources.schemas import schema
from ledgerlark.sources.sinks import append_facts, as_json, write_snapshot
from ledgerlark.streaming.billing import (dedup_events, fold_billing, fold_billing_stream,
                                          latest_states, run_billing_stream, snapshot_writer)


def test_append_partitioned_by_month_prunes(spark):
    root = tempfile.mkdtemp(prefix="facts-")
    p = load_tables(spark, SF_SMALL).payments
    append_facts(p, f"{root}/payments", ts_col="created_at")
    back = spark.read.parquet(f"{root}/payments")
    assert back.count() == p.count()
    q = back.where(F.col("month_part") == "1998-03")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "1998-03" in plan
    assert q.count() == p.where(F.date_format("created_at", "yyyy-MM") == "1998-03").count()


def test_snapshot_roundtrip(spark):
    root = tempfile.mkdtemp(prefix="snap-")
    t = load_tables(spark, SF_SMALL)
    new = ac.start_trials(t.businesses, t.trial_requests, "2024-01-31 00:00:00").drop("changed")
    write_snapshot(new, f"{root}/businesses")
    back = read_domain_tables(spark, root).businesses
    assert back.exceptAll(new).count() == 0 and new.exceptAll(back).count() == 0


def test_subscription_card_as_nested_json(spark):
    b = mk(spark, "businesses", [{"id": 1, "trial_reviews_remaining": 3}])
    s = mk(spark, "subscriptions", [{"id": 1, "business_id": 1, "status": "active",
                                     "card_brand": "visa", "card_last4": "4242"}])
    card = ac.subscription_status(b, s)
    out = as_json(card, nested={"paymentMethod": ["card_last4", "card_brand", "card_display_name"]})
    doc = json.loads(out.first()["json"])
    assert doc["paymentMethod"] == {"card_last4": "4242", "card_brand": "visa",
                                    "card_display_name": "Visa ending in 4242"}
    assert doc["is_subscribed"] is True and doc["status"] == "active"


def test_stream_snapshot_writer_and_dedup(spark):
    t = load_tables(spark, SF_SMALL)
    e = t.billing_events.where("business_id IS NOT NULL")
    src = tempfile.mkdtemp(prefix="billing-src-") + "/in"
    e.unionByName(e.limit(5)).repartition(4).write.parquet(src)   # every event plus 5 repeats
    stream = spark.readStream.schema(schema("billing_events")).option("maxFilesPerTrigger", 2).parquet(src)
    out_dir = tempfile.mkdtemp(prefix="billing-out-")
    q = (fold_billing_stream(stream, t.subscriptions, "3650 days").writeStream
         .foreachBatch(snapshot_writer(out_dir)).outputMode("update")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="ck-"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["business_id"]: r for r in latest_states(spark, out_dir).collect()}
    snap, status, _ = fold_billing(e, t.subscriptions)
    want = {r["business_id"]: r["subscription_status"] for r in status.collect()}
    assert {k: v["subscription_status"] for k, v in got.items()} == want

    dd = dedup_events(spark.readStream.schema(schema("billing_events")).parquet(src), "3650 days")
    seen = []
    q = (dd.writeStream.foreachBatch(lambda df, i: seen.extend(r["event_id"] for r in df.collect()))
         .option("checkpointLocation", tempfile.mkdtemp(prefix="ck-")).trigger(availableNow=True).start())
    q.awaitTermination()
    named = [i for i in seen if i is not None]
    assert len(named) == len(set(named)) == e.where("event_id IS NOT NULL").select("event_id").distinct().count()
    # events without an id are never equal: all of them stay
    assert len(seen) - len(named) == spark.read.parquet(src).where("event_id IS NULL").count() > 0


def test_run_billing_stream_end_to_end(spark):
    t = load_tables(spark, SF_SMALL)
    e = t.billing_events
    src = tempfile.mkdtemp(prefix="billing-src-") + "/in"
    e.repartition(3).write.parquet(src)
    out = tempfile.mkdtemp(prefix="billing-out-")
    q = run_billing_stream(spark, src, out, tempfile.mkdtemp(prefix="ck-"), t.subscriptions, "3650 days", files_per_batch=1,
                           available_now=True, name="e2e")
    q.awaitTermination()
    got = {r["business_id"]: (r["status"], r["subscription_status"])
           for r in latest_states(spark, out).collect()}
    snap, status, _ = fold_billing(e, t.subscriptions)
    snap = {r["business_id"]: r["status"] for r in snap.collect()}
    status = {r["business_id"]: r["subscription_status"] for r in status.collect()}
    assert {k: v[1] for k, v in got.items()} == status
    assert all(v[0] == snap.get(k) for k, v in got.items())


def test_stream_from_json_files(spark):
    from ledgerlark.streaming.billing import read_billing_events
    t = load_tables(spark, SF_SMALL)
    e = t.billing_events.where("business_id IS NOT NULL")
    src = tempfile.mkdtemp(prefix="billing-json-") + "/in"
    e.write.json(src)
    seen = []
    q = (read_billing_events(spark, src, fmt="json").writeStream
         .foreachBatch(lambda df, i: seen.extend(r["event_id"] for r in df.select("event_id").collect()))
         .option("checkpointLocation", tempfile.mkdtemp(prefix="ck-")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(seen, key=str) == sorted((r["event_id"] for r in e.select("event_id").collect()), key=str)


def test_command_line_runner(spark):
    from ledgerlark.__main__ import main
    out = tempfile.mkdtemp(prefix="cli-") + "/r"
    assert main(["monthly_financials", "--sf-dir", SF_SMALL, "--out", out]) == 0
    assert spark.read.parquet(out).count() == 12
