"""Typed keyed state of the billing stream, its intake, and the scoped sinks."""

import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers_business import SF_SMALL, mk, ts
from ledgerlark.operators import referrals as rf
from ledgerlark.operators.common import P, T, upsert
from ledgerlark.sources import load_tables
from ledgerlark.sources.schemas import schema
from ledgerlark.sources.sinks import append_facts, read_partitions, upsert_partitions
from ledgerlark.streaming import billing as bl

CO, PAID = "checkout.session.completed", "invoice.payment_succeeded"


def ev(i, t, typ=PAID, sub="sub_a", bid=1, **more):
    return {"event_id": i, "event_ts": ts(t), "type": typ, "stripe_subscription_id": sub, "business_id": bid,
            "status": "active", "cancel_at_period_end": False, "amount": 1000, **more}


@pytest.fixture
def job(spark):
    """Feeds files of events, one micro-batch each, to the whole streaming job."""
    src, out, ck = (tempfile.mkdtemp(prefix=f"billing-{k}-") for k in ("src", "out", "ck"))

    class Job:
        checkpoint = ck

        def run(self, *files, base=None, delay="1 day", remember=None):
            for rows in files:
                mk(spark, "billing_events", rows).coalesce(1).write.mode("append").parquet(src)
                bl.run_billing_stream(spark, src, out, ck, base, delay, remember, files_per_batch=1,
                                      available_now=True).awaitTermination()
            return {r["business_id"]: r for r in bl.latest_states(spark, out).collect()}

        def rejects(self):
            return {r["reason"]: r["events"] for r in bl.stream_rejects(spark, out).collect()}

        def state(self, name):
            read = spark.read.format("statestore").option("path", ck).option("stateVarName", name)
            return (read.option("flattenCollectionTypes", True) if name == "events" else read).load()
    return Job()


def test_a_quiet_business_settles_by_timer(job):
    first = job.run([ev("a", "2024-01-01 00:00:00", CO), ev("b", "2024-01-01 12:00:00", CO, "sub_b", 2)])
    assert first[1]["waiting"] == 1 and first[2]["waiting"] == 1
    last = job.run([ev("c", "2024-02-01 00:00:00", bid=2, sub="sub_b")], [ev("d", "2024-02-01 01:00:00", bid=2, sub="sub_b")])
    assert last[1]["waiting"] == 0 and last[1]["status"] == "active"       # no event of business 1 since the first file
    assert last[2]["waiting"] == 2


def test_state_does_not_grow_with_processed_events(job):
    days = [f"2024-{m:02d}-{d:02d} 00:00:00" for m in (1, 2, 3) for d in range(1, 29)]
    sizes = []
    for k in (0, 1, 2):
        job.run([ev(f"e{t}", t, CO if i == k == 0 else PAID) for i, t in enumerate(days[28 * k:28 * k + 28])])
        sizes.append(job.state("events").count())
    assert max(sizes) <= 32 and sizes[2] <= sizes[1], sizes   # at most a file's events and those of the last two days
    row = job.state("folded").collect()[0]["value"]
    assert row["row_exists"] and row["stripe_subscription_id"] == "sub_a" and row["last_event"].startswith("e2024-0")


def test_repeats_are_told_from_late_events(job):
    """A repeat of a folded event inside the remembered time, one beyond it, a late event, and id-less events."""
    a, b = ev("a", "2024-01-01 00:00:00", CO), ev("b", "2024-01-10 00:00:00")
    job.run([a, b, b], [ev("c", "2024-01-20 00:00:00")], [ev("c2", "2024-01-20 00:00:01")], remember="15 days")
    assert job.rejects() == {"duplicate": 1}
    job.run([b, a, ev("x", "2024-01-02 00:00:00"), ev("c", "2024-01-20 00:00:00")], remember="15 days")
    assert job.rejects() == {"duplicate": 3, "late": 2}       # a is forgotten: late
    got = job.run([ev(None, "2024-01-21 00:00:00", bid=7), ev(None, "2024-01-21 00:00:00", bid=8),
                   ev(None, "2024-01-21 00:00:00", bid=8, status="past_due")], remember="15 days")
    assert job.rejects() == {"duplicate": 3, "late": 2} and got[8]["waiting"] == 2 and got[7]["waiting"] == 1


def test_stored_subscriptions_are_the_initial_state(spark, job):
    base = mk(spark, "subscriptions", [{"id": 5, "business_id": 1, "status": "active", "stripe_subscription_id": "sub_old",
                                        "amount": 700, "current_period_end": ts("2024-03-01 00:00:00")},
                                       {"id": 6, "business_id": 3, "stripe_subscription_id": "sub_3"}])
    rows = [ev("a", "2024-01-01 00:00:00", "customer.subscription.deleted", "sub_old"), ev("b", "2024-01-03 00:00:00", sub="other")]
    got = job.run(rows, base=base)
    snap = {r["business_id"]: r for r in bl.fold_billing(mk(spark, "billing_events", rows), base)[0].collect()}
    assert all(got[1][c] == snap[1][c] for c in bl.SUB_OUT) and got[1]["status"] == "cancelled" and set(got) == {1}


# ---- intake ----------------------------------------------------------------

def body(i, business, **more):
    return json.dumps({**({"id": i} if i is not None else {}), "type": CO, "created": 1700000000,
                       "data": {"object": {"id": "cs", "subscription": "s", "metadata": {"business_id": business}}}, **more})


def test_quarantine_keeps_bad_bodies_apart(spark):
    """Three malformed bodies, two good events, and id-less ones of businesses 7 and 8."""
    bodies = ["{", "{", "[1]", None, "", "{}", body("evt_1", "1")[:-9], body("evt_1", "1"), body("evt_2", "2"), body("evt_2", "2"),
              body(None, "7"), body(None, "8"), body("", "8"), body("evt_3", "3", created="soon")]
    events, quarantine = bl.intake_provider_events(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert sorted(r["event_id"] for r in events.collect()) == ["evt_1", "evt_2", "evt_2"]
    rows = quarantine.collect()
    assert len({(r["digest"], r["reason"]) for r in rows}) == len(rows)
    counts = {why: sum(r["bodies"] for r in rows if r["reason"] == why) for why in ("malformed", "no_id")}
    assert counts == {"malformed": 8, "no_id": 3} and {r["body"]: r["bodies"] for r in rows}["{"] == 2


def test_events_without_an_id_are_never_equal(spark):
    rows = [ev(None, "2024-01-01 00:00:00", CO, "sub_7", 7), ev(None, "2024-01-01 00:00:00", CO, "sub_8", 8),
            ev("a", "2024-01-02 00:00:00", CO, "sub_a", 1), ev("a", "2024-01-02 00:00:00", CO, "sub_a", 1),
            ev(None, "2024-01-03 00:00:00", "other", "s", 9), ev(None, "2024-01-03 00:00:00", CO, "s", None)]
    snap, status, rejects = bl.fold_billing(mk(spark, "billing_events", rows))
    assert {r["business_id"]: r["stripe_subscription_id"] for r in snap.collect()} == {7: "sub_7", 8: "sub_8", 1: "sub_a"}
    assert {r["business_id"]: r["last_event_id"] for r in status.collect()} == {7: None, 8: None, 1: "a"}
    assert {r["reason"]: r["events"] for r in rejects.collect()} == {"duplicate": 1, "unknown_type": 1, "no_business": 1}


# ---- M20 -------------------------------------------------------------------

def test_codes_are_drawn_until_free(spark):
    """Few codes for many businesses: every draw clashes for most of them."""
    rows = [{"id": i, "referral_code": None if i > 4 else f"{i}"} for i in range(1, 31)] + [{"id": 31, "referral_code": "1"}]
    few = lambda business, attempt: F.pmod(F.xxhash64(business, F.lit(attempt)), F.lit(40)).cast("string")
    got = rf.fill_referral_codes(mk(spark, "businesses", rows), "x", few).collect()
    codes = [r["referral_code"] for r in got]
    assert len(got) == 31 and None not in codes and len(set(codes)) == 30      # the stored pair may share, nobody else
    assert {r["id"]: r["referral_code"] for r in got if not r["generated"]} == {1: "1", 2: "2", 3: "3", 4: "4", 31: "1"}
    with pytest.raises(RuntimeError):
        rf.fill_referral_codes(mk(spark, "businesses", rows), "x", lambda business, attempt: F.lit("same"), max_rounds=3)


def test_codes_without_a_clash_are_one_scan(spark):
    b = load_tables(spark, SF_SMALL).businesses
    plan = rf.fill_referral_codes(b, "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= b._jdf.queryExecution().executedPlan().toString().count("FileScan") and "Exchange" not in plan


# ---- S3, S4 ----------------------------------------------------------------

def test_append_bounds_files_and_repeats_add_nothing(spark):
    root = tempfile.mkdtemp(prefix="facts-") + "/payments"
    p = load_tables(spark, SF_SMALL).payments.repartition(7)
    for run in ("one", "two", "one"):
        append_facts(p, root, "created_at", run_id=run)
    back = spark.read.parquet(root)
    assert back.count() == 2 * p.count() and back.where("run_part = 'one'").exceptAll(back.where("run_part = 'two'").withColumn(
        "run_part", F.lit("one"))).count() == 0
    months = [d for d in Path(root).iterdir() if d.is_dir()]
    assert len(months) > 10 and all(len(list(d.glob("run_part=one/*.parquet"))) == 1 for d in months)


def test_scoped_upsert_rewrites_only_touched_partitions(spark):
    root = tempfile.mkdtemp(prefix="upsert-")
    t = load_tables(spark, SF_SMALL).bank_details.withColumn("part", F.col("business_id") % 8)
    t.write.partitionBy("part").parquet(f"{root}/old")
    ids = [8, 16, 3, 100_003]                                 # partitions 0 and 3; the last is new
    ch = spark.createDataFrame([(i, f"New {i}") for i in ids], "business_id long, holder string").withColumn(
        "part", F.col("business_id") % 8)

    def merge(old, changes):
        return upsert(old, changes, ["business_id"], {"account_holder_name": P("holder"), "part": T("part")},
                      {"account_holder_name": P("holder"), "part": P("part")})
    for _ in range(2):                                        # a rerun replaces its own output
        assert sorted(upsert_partitions(f"{root}/old", f"{root}/new", ch, ["business_id"], "part", merge)) == [0, 3]
    assert sorted(d.name for d in Path(f"{root}/new").iterdir() if d.is_dir()) == ["part=0", "part=3"]
    got = read_partitions(spark, f"{root}/old", f"{root}/new", "part").select(*t.columns)
    want = merge(t, ch).select(*t.columns)
    kinds = [F.col(c).cast("string") for c in t.columns]
    assert got.count() == want.count() and got.select(*kinds).exceptAll(want.select(*kinds)).count() == 0


def test_only_businesses_with_events_cost_state(job, spark):
    """Stored rows come with a business's first event, as they were when the stream first started."""
    row = {"status": "active", "created_at": ts("2023-01-01 00:00:00"), "amount": 500}
    base = mk(spark, "subscriptions", [{"id": i, "business_id": i, "stripe_subscription_id": f"sub_{i}", **row} for i in (1, 2, 3)])
    first = job.run([ev("a", "2024-01-01 00:00:00", sub="sub_1")], base=base)
    assert first[1]["id"] == 1 and first[1]["row_exists"] and job.state("folded").count() == 1
    later = job.run([ev("b", "2024-01-01 01:00:00", sub="sub_2", bid=2)], base=None)
    assert later[2]["id"] == 2 and later[2]["amount"] == 500 and later[2]["updated_at"] == ts("2024-01-01 01:00:00")
    assert job.state("folded").count() == 2
