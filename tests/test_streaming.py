"""Billing fold: hand cases (T2-T7) and stream fold == batch fold."""

import random
import tempfile

import pytest

from helpers_business import SF_SMALL, mk, ts
from ledgerlark.sources import load_tables
from ledgerlark.sources.schemas import schema
from ledgerlark.streaming.billing import SUB_OUT, fold_billing, fold_billing_stream

CO, UPD, DEL, PAID = ("checkout.session.completed", "customer.subscription.updated",
                      "customer.subscription.deleted", "invoice.payment_succeeded")


def ev(i, t, typ, sub, bid=1, status="active", cancel=False):
    return {"event_id": f"evt_{i}", "event_ts": ts(t), "type": typ, "stripe_subscription_id": sub,
            "business_id": bid, "status": status, "cancel_at_period_end": cancel, "amount": 1000}


def run_stream(spark, events_df, base, delay, files: list[list[int]] | None = None, seed=7):
    """Feed events as parquet files (one micro-batch each); return (states, late)."""
    rows = events_df.collect()
    if files is None:
        idx = list(range(len(rows)))
        random.Random(seed).shuffle(idx)
        files = [idx[i:i + max(1, len(idx) // 5)] for i in range(0, len(idx), max(1, len(idx) // 5))]
    src = tempfile.mkdtemp(prefix="billing-src-")
    for f in files:
        spark.createDataFrame([rows[i] for i in f], schema("billing_events")).coalesce(1) \
            .write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema("billing_events")).option("maxFilesPerTrigger", 1).parquet(src)
    out = fold_billing_stream(stream, base, delay)
    states, late = {}, []

    def sink(df, batch_id):
        for r in df.collect():
            if r["record"] == "state":
                states[r["business_id"]] = r.asDict()
            else:
                late.append(r["event_id"])

    q = (out.writeStream.foreachBatch(sink).outputMode("update")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="billing-ckpt-"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return states, late


def both(spark, rows, base=None):
    e = mk(spark, "billing_events", rows)
    snap, status, _ = fold_billing(e, base)
    states, _ = run_stream(spark, e, base, "3650 days", files=[[i] for i in range(len(rows))])
    return {r["business_id"]: r.asDict() for r in snap.collect()}, \
        {r["business_id"]: r["subscription_status"] for r in status.collect()}, states


def test_t3_first_cancel_kept(spark):
    rows = [ev(1, "2024-01-01 00:00:00", CO, "sub_a"),
            ev(2, "2024-01-02 00:00:00", UPD, "sub_a", cancel=True),
            ev(3, "2024-01-03 00:00:00", UPD, "sub_a", cancel=False),
            ev(4, "2024-01-04 00:00:00", UPD, "sub_a", cancel=True)]
    snap, status, st = both(spark, rows)
    assert snap[1]["cancelled_at"] == ts("2024-01-02 00:00:00") == st[1]["cancelled_at"]
    assert snap[1]["status"] == "cancelling" == st[1]["status"]


def test_t5_paid_revives(spark):
    rows = [ev(1, "2024-01-01 00:00:00", CO, "sub_a"), ev(2, "2024-01-02 00:00:00", DEL, "sub_a"),
            ev(3, "2024-01-03 00:00:00", PAID, "sub_a")]
    snap, status, st = both(spark, rows)
    assert snap[1]["status"] == "active" == st[1]["status"]
    assert snap[1]["ended_at"] == ts("2024-01-02 00:00:00") == st[1]["ended_at"]


def test_t3_early_update(spark):
    rows = [ev(1, "2024-01-01 00:00:00", UPD, "sub_a", status="past_due")]
    snap, status, st = both(spark, rows)
    assert 1 not in snap and st[1]["row_exists"] is False
    assert status[1] == "past_due" == st[1]["subscription_status"]


def test_t2_replaced_subscription(spark):
    rows = [ev(1, "2024-01-01 00:00:00", CO, "sub_a"), ev(2, "2024-01-02 00:00:00", CO, "sub_b"),
            ev(3, "2024-01-03 00:00:00", DEL, "sub_a")]
    snap, status, st = both(spark, rows)
    assert (snap[1]["stripe_subscription_id"], snap[1]["status"]) == ("sub_b", "active")
    assert (st[1]["stripe_subscription_id"], st[1]["status"]) == ("sub_b", "active")
    assert status[1] == "cancelled" == st[1]["subscription_status"]


def test_stream_equals_batch_shuffled_with_repeat(spark):
    t = load_tables(spark, SF_SMALL)
    e = t.billing_events.where("business_id IS NOT NULL AND type <> 'ignored.type'")
    rows = e.collect()
    e = e.unionByName(spark.createDataFrame([rows[3]], schema("billing_events")))  # one repeated event
    base = t.subscriptions
    snap, status, _ = fold_billing(e, base)
    states, late = run_stream(spark, e, base, "3650 days")
    again = {r["event_id"] for r in rows} - {None}
    named = e.where("event_id IS NOT NULL")
    assert len(late) == named.count() - len(again) and set(late) <= again     # every repeat is told
    snap = {r["business_id"]: r.asDict() for r in snap.collect()}
    status = {r["business_id"]: r["subscription_status"] for r in status.collect()}
    assert states and set(status) == set(states)
    for bid, s in states.items():
        assert s["subscription_status"] == status[bid]
        if s["row_exists"]:
            for c in SUB_OUT:                     # a new row gets its id when the states are read
                assert s[c] == snap[bid][c] or c == "id" and s[c] is None, (bid, c)
        else:
            assert bid not in snap


def test_late_events_rejected_and_counted(spark):
    rows = [ev(1, "2024-01-10 00:00:00", CO, "sub_a"), ev(2, "2024-01-20 00:00:00", PAID, "sub_a"),
            ev(3, "2024-01-01 00:00:00", DEL, "sub_a")]
    e = mk(spark, "billing_events", rows)
    states, late = run_stream(spark, e, None, "1 day", files=[[0], [1], [2]])
    assert late == ["evt_3"]
    assert states[1]["status"] == "active"


def test_stream_commits_with_advancing_watermark(spark):
    t = load_tables(spark, SF_SMALL)
    e = t.billing_events.where("business_id IS NOT NULL AND type <> 'ignored.type'").dropDuplicates(["event_id"])
    rows = e.collect()
    e = spark.createDataFrame(rows, e.schema)
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["event_ts"], rows[i]["event_id"]))
    n = max(1, len(order) // 6)
    files = [order[i:i + n] for i in range(0, len(order), n)]         # chronological chunks
    for f in files:
        random.Random(len(f)).shuffle(f)                              # disorder inside a chunk
    states, late = run_stream(spark, e, t.subscriptions, "1 day", files=files)
    assert late == []
    snap, status, _ = fold_billing(e, t.subscriptions)
    snap = {r["business_id"]: r.asDict() for r in snap.collect()}
    status = {r["business_id"]: r["subscription_status"] for r in status.collect()}
    for bid, s in states.items():
        assert s["subscription_status"] == status[bid]
        if s["row_exists"]:
            for c in SUB_OUT:
                assert s[c] == snap[bid][c] or c == "id" and s[c] is None, (bid, c)


def test_restart_resumes_and_equals_the_batch_fold(spark):
    """Stop after two files, add a third with an older and a newer event, restart
    with another batch size: the states and rejects are those of one run."""
    from ledgerlark.streaming.billing import latest_states, run_billing_stream, stream_rejects
    rows = [ev(1, "2024-01-01 00:00:00", CO, "sub_a"), ev(2, "2024-01-05 00:00:00", PAID, "sub_a"),
            ev(3, "2024-01-02 00:00:00", CO, "sub_x", bid=2), ev(4, "2024-01-06 00:00:00", UPD, "sub_x", bid=2, status="past_due"),
            ev(5, "2024-01-07 00:00:00", DEL, "sub_a"), ev(6, "2024-01-03 00:00:00", UPD, "sub_a", cancel=True),
            ev(5, "2024-01-07 00:00:00", DEL, "sub_a"), {**ev(7, "2024-01-07 00:00:00", "other", "s")},
            {**ev(8, "2024-01-07 00:00:00", CO, "s"), "business_id": None}]
    e = mk(spark, "billing_events", rows)
    got = e.collect()
    src, out, ck = (tempfile.mkdtemp(prefix=f"billing-{k}-") for k in ("src", "out", "ck"))

    def put(part):
        spark.createDataFrame(part, schema("billing_events")).coalesce(1).write.mode("append").parquet(src)

    def go(files):
        run_billing_stream(spark, src, out, ck, None, "3650 days", files_per_batch=files, available_now=True).awaitTermination()
    put(got[:2])
    put(got[2:4])
    go(1)
    put(got[4:])
    go(5)
    states = {r["business_id"]: r for r in latest_states(spark, out, mk(spark, "subscriptions", [{"id": 70, "business_id": 9}])).collect()}
    snap, status, _ = fold_billing(e)
    for r in snap.collect():
        for c in SUB_OUT:
            assert states[r["business_id"]][c] == r[c] or c == "id", c
        assert states[r["business_id"]]["id"] == 70 + r["business_id"]
    assert {b: s["subscription_status"] for b, s in states.items()} == {r["business_id"]: r["subscription_status"] for r in status.collect()}
    assert {r["reason"]: r["events"] for r in stream_rejects(spark, out).collect()} == {
        "duplicate": 1, "unknown_type": 1, "no_business": 1}


def test_provider_ids_and_bad_business_ids(spark):
    import json

    from ledgerlark.streaming.billing import parse_provider_events, route_events
    body = lambda i, b: json.dumps({"id": i, "type": CO, "created": 1700000000, "data": {"object": {
        "id": "cs", "subscription": "s", "metadata": {"business_id": b}}}})
    raw = spark.createDataFrame([(body("evt_1NAbc9", "1"),), (body("evt_2QXyz9", "2"),), (body("evt_end", "x7"),)], "body string")
    clean, rejects = route_events(parse_provider_events(raw))
    assert sorted(r["event_id"] for r in clean.collect()) == ["evt_1NAbc9", "evt_2QXyz9"]
    assert {r["reason"]: r["events"] for r in rejects.collect()} == {"duplicate": 0, "unknown_type": 0, "no_business": 1}
