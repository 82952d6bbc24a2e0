"""Billing events folded into subscription state.

Event kinds (provider type -> kind): checkout.session.completed -> checkout,
customer.subscription.updated -> updated, customer.subscription.deleted ->
deleted, invoice.payment_succeeded -> paid.  Other types are ignored (T1);
events without a business id are dropped (T6); repeated event ids count once
(T1, new); order is (event_ts, event_id) (T7).

Two folds, one answer:

* the *subscription row* of a business (keyed by business): a checkout upserts
  it and replaces its provider subscription id; updated / deleted / paid
  events change it only while their subscription id is the row's current one
  (the reference UPDATEs by subscription id).  cancelled_at is the first
  cancel (update with cancel-at-period-end, or delete) and is never cleared;
  ended_at is the last delete.
* the *business status* (keyed by business): every event sets it, whatever
  its subscription id.

``fold_billing`` is the batch form, a set of joins and aggregates;
``fold_billing_stream`` is the Structured Streaming form with typed keyed state
and timers (``keyed.BillingFold``); the tests check they agree.  An event without
an id is an event of its own: NULL ids are never equal.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed import EVENT_KINDS
from ..operators.common import Desc, above_max, apply_patch, latest_by_key, running_count
from ..operators.subscriptions import current_subscriptions
from ..sources.schemas import schema
from .keyed import BASE_FIELDS, EVENT_FIELDS, BillingFold


SUB_OUT = ["id", "business_id", "stripe_subscription_id", "stripe_customer_id", "status",
           "amount", "current_period_end", "card_last4", "card_brand", "payment_method",
           "cancel_at_period_end", "cancelled_at", "ended_at", "updated_at"]


# what the business status needs
STATUS_COLS = ["event_id", "event_ts", "type", "business_id", "status", "cancel_at_period_end"]


# Nested shape of a provider event as delivered to the webhook (the fields the
# handlers read).  Times are epoch seconds; the price sits in items.data[0].
PROVIDER_EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("created", T.LongType()),
    T.StructField("data", T.StructType([T.StructField("object", T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("customer", T.StringType()),
        T.StructField("subscription", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("cancel_at_period_end", T.BooleanType()),
        T.StructField("current_period_end", T.LongType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("items", T.StructType([T.StructField("data", T.ArrayType(T.StructType([
            T.StructField("price", T.StructType([T.StructField("unit_amount", T.LongType())]))])))])),
        T.StructField("default_payment_method", T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("card", T.StructType([T.StructField("last4", T.StringType()),
                                                T.StructField("brand", T.StringType())]))])),
        T.StructField("default_source", T.StructType([
            T.StructField("object", T.StringType()), T.StructField("last4", T.StringType()),
            T.StructField("brand", T.StringType())])),
    ]))])),
])


def parse_provider_events(raw: DataFrame, body: str = "body") -> DataFrame:
    """Raw JSON bodies -> the billing event schema.

    ``from_json`` with a declared schema (no inference), epoch seconds through
    ``timestamp_seconds``, the amount from ``items.data[0].price.unit_amount``.
    The subscription id is the object id, except for checkout sessions and
    invoices, which name it in ``subscription``; the business id is the
    customer's metadata (``business_id`` or ``businessId``); one that is no
    number becomes NULL, so the event is counted as ``no_business``.  The event
    id is kept as the provider writes it.  A checkout's card is chosen by
    ``checkout_card`` (T2).
    """
    return _event_columns(raw.select(F.from_json(F.col(body), PROVIDER_EVENT).alias("e")))


def intake_provider_events(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """S2 with a quarantine: ``(events, quarantine)`` of raw JSON bodies.

    A body that is no JSON object of the declared shape is ``malformed``
    (``from_json`` keeps it in its corrupt-record column); one that names no
    event id is ``no_id``.  Neither reaches the fold.  The quarantine has one row
    per distinct body: its SHA-256 digest, the reason, the body and how often it
    came.  All other bodies become events as in ``parse_provider_events``.
    """
    kept = F.col(body)
    shape = T.StructType([*PROVIDER_EVENT.fields, T.StructField("_corrupt", T.StringType())])
    e = raw.select(kept.alias("body"), F.from_json(kept, shape, {"columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    nothing = F.coalesce(F.col("e.id"), F.col("e.type"), F.col("e.created").cast("string")).isNull() & F.col("e.data").isNull()
    e = e.withColumn("reason", F.when(F.col("e").isNull() | F.col("e._corrupt").isNotNull() | nothing, "malformed")
                     .when(F.coalesce(F.trim("e.id"), F.lit("")) == "", "no_id"))
    quarantine = e.where("reason is not null").groupBy(
        F.sha2(F.coalesce("body", F.lit("")), 256).alias("digest"), "reason").agg(
        F.first("body").alias("body"), F.count(F.lit(1)).alias("bodies"))
    return _event_columns(e.where("reason is null").select("e")), quarantine


def _event_columns(e: DataFrame) -> DataFrame:
    o = F.col("e.data.object")
    sub = F.when(F.col("e.type").isin("checkout.session.completed", "invoice.payment_succeeded"),
                 o["subscription"]).otherwise(o["id"])
    md = o["metadata"]
    return e.select(
        F.col("e.id").alias("event_id"),
        F.timestamp_seconds(F.col("e.created")).alias("event_ts"),
        F.col("e.type").alias("type"),
        sub.alias("stripe_subscription_id"),
        o["customer"].alias("stripe_customer_id"),
        F.coalesce(md.getItem("business_id"), md.getItem("businessId")).try_cast("long").alias("business_id"),
        o["status"].alias("status"),
        o["cancel_at_period_end"].alias("cancel_at_period_end"),
        o["items"]["data"].getItem(0)["price"]["unit_amount"].alias("amount"),
        F.timestamp_seconds(o["current_period_end"]).alias("current_period_end"),
        checkout_card(o)["last4"].alias("card_last4"),
        checkout_card(o)["brand"].alias("card_brand"))


def checkout_card(o: F.Column) -> F.Column:
    """The card of the default payment method if that is a card, else the
    customer's default source if that is a card, else NULL."""
    method, source = o["default_payment_method"], o["default_source"]
    return (F.when(method["type"] == "card", method["card"])
            .when(source["object"] == "card", F.struct(source["last4"].alias("last4"), source["brand"].alias("brand"))))


def read_billing_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stream of billing events from files with the declared schema.

    A Kafka source works the same way: ``readStream.format("kafka")`` then
    ``from_json(value, schema("billing_events"))``.
    """
    return spark.readStream.schema(schema("billing_events")).format(fmt).load(path)


def kind_col(type_col="type") -> F.Column:
    c = F.col(type_col)
    out = F.lit(None).cast("string")
    for t, k in reversed(list(EVENT_KINDS.items())):
        out = F.when(c == t, F.lit(k)).otherwise(out)
    return out


def derived_status() -> F.Column:
    """Status an event writes: checkout/paid -> active, deleted -> cancelled,
    updated -> cancelling when active with cancel-at-period-end, else the
    provider status (T2-T5)."""
    k = F.col("kind")
    upd = F.when(F.coalesce(F.col("cancel_at_period_end"), F.lit(False)) & (F.col("status") == "active"),
                 F.lit("cancelling")).otherwise(F.col("status"))
    return (F.when(k.isin("checkout", "paid"), F.lit("active"))
            .when(k == "deleted", F.lit("cancelled")).otherwise(upd))


def route_events(events: DataFrame):
    """T1 + T6: dedup by event id (earliest copy), keep known types with a
    business.  Returns ``(clean, rejects)``; rejects counts by reason.

    Events without an id are not copies of each other; all are kept.

    One aggregate per event id gives both the kept copy (``min`` of a struct
    led by event_ts) and the number of copies, so the reject counts need no
    second pass over the raw events.
    """
    cols = list(events.columns)
    packed = F.struct(F.col("event_ts").isNull().alias("__n"), F.col("event_ts").alias("__t"),
                      *[F.col(c).alias(c) for c in cols if c != "event_id"])
    own = F.when(F.col("event_id").isNull(), F.monotonically_increasing_id())
    g = events.withColumn("__own", own).groupBy("event_id", "__own").agg(F.min(packed).alias("__m"),
                                                                         F.count(F.lit(1)).alias("__copies"))
    first = g.select("event_id", *[F.col(f"__m.{c}").alias(c) for c in cols if c != "event_id"],
                     "__copies").withColumn("kind", kind_col())
    clean = first.where(F.col("kind").isNotNull() & F.col("business_id").isNotNull()) \
        .drop("__copies").select(*cols, "kind")
    rej = first.agg(
        F.sum(F.col("__copies") - 1).alias("duplicate"),
        F.count(F.when(F.col("kind").isNull(), 1)).alias("unknown_type"),
        F.count(F.when(F.col("kind").isNotNull() & F.col("business_id").isNull(), 1)).alias("no_business"),
    ).select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("reason"), F.coalesce(F.col(r), F.lit(0)).cast("long").alias("events"))
        for r in ("duplicate", "unknown_type", "no_business")])).alias("r")).select("r.reason", "r.events")
    return clean, rej


def fold_billing(events: DataFrame, subscriptions: DataFrame | None = None):
    """Batch fold (T1-T7).  Returns ``(subscriptions_snapshot, business_status,
    rejects)``.

    Which subscription id is current when an event happens is found without a
    per-business window: a distributed prefix count of checkouts gives each
    event its checkout epoch, and the epoch's checkout (an equi join on
    business and epoch) supplies the id; before any checkout the stored row's
    id is current.  Everything else is conditional aggregation per business.
    """
    clean, rejects = route_events(events)
    ev = clean.withColumn("new_status", derived_status()).withColumn("event_id", F.coalesce("event_id", F.lit("")))
    ev = running_count(ev, "business_id", ["event_ts", "event_id"], "epoch",
                       flag=F.col("kind") == "checkout", inclusive=True)
    co = ev.where(F.col("kind") == "checkout").select(
        "business_id", "epoch", F.col("stripe_subscription_id").alias("epoch_sub"))
    if subscriptions is not None:
        base = current_subscriptions(subscriptions)
    else:
        base = subscriptions_placeholder(events.sparkSession)
    bkey = base.select("business_id", F.col("stripe_subscription_id").alias("base_sub"))
    e = ev.join(co, ["business_id", "epoch"], "left").join(bkey, "business_id", "left")
    applies = (F.col("kind") == "checkout") | F.coalesce(
        F.coalesce(F.col("epoch_sub"), F.col("base_sub")) == F.col("stripe_subscription_id"), F.lit(False))
    app = e.where(applies)

    order = [F.col("event_ts"), F.col("event_id")]
    is_co = F.col("kind") == "checkout"
    agg = app.groupBy("business_id").agg(
        F.max(F.struct(*order, F.col("new_status").alias("st"))).alias("last_app"),
        F.max(F.when(F.col("kind") == "updated",
                     F.struct(*order, F.col("cancel_at_period_end").alias("cape")))).alias("last_upd"),
        F.min(F.when(((F.col("kind") == "updated") & F.coalesce(F.col("cancel_at_period_end"), F.lit(False)))
                     | (F.col("kind") == "deleted"), F.col("event_ts"))).alias("first_cancel"),
        F.max(F.when(F.col("kind") == "deleted", F.col("event_ts"))).alias("last_delete"),
        F.max(F.when(is_co, F.struct(*order, "stripe_subscription_id", "stripe_customer_id", "amount",
                                     "current_period_end", "card_last4", "card_brand"))).alias("co"),
    )
    b = base.select(*[F.col(c).alias(f"b_{c}") for c in base.columns], F.lit(True).alias("has_base"))
    j = b.join(agg, F.col("b_business_id") == F.col("business_id"), "full_outer")
    j = j.where(F.col("has_base").isNotNull() | F.col("co").isNotNull())
    hco = F.col("co").isNotNull()

    def pick(field, basecol):
        return F.when(hco, F.col(f"co.{field}")).otherwise(F.col(f"b_{basecol}"))

    snap = j.select(
        F.coalesce(F.col("b_id"), above_max(base if subscriptions is None else subscriptions, F.col("business_id"))).alias("id"),
        F.coalesce(F.col("b_business_id"), F.col("business_id")).alias("business_id"),
        pick("stripe_subscription_id", "stripe_subscription_id").alias("stripe_subscription_id"),
        pick("stripe_customer_id", "stripe_customer_id").alias("stripe_customer_id"),
        F.when(F.col("last_app").isNotNull(), F.col("last_app.st"))
        .otherwise(F.col("b_status")).alias("status"),
        pick("amount", "amount").alias("amount"),
        pick("current_period_end", "current_period_end").alias("current_period_end"),
        pick("card_last4", "card_last4").alias("card_last4"),
        pick("card_brand", "card_brand").alias("card_brand"),
        F.when(hco, F.lit("card")).otherwise(F.col("b_payment_method")).alias("payment_method"),
        F.when(F.col("last_upd").isNotNull(), F.col("last_upd.cape"))
        .otherwise(F.col("b_cancel_at_period_end")).alias("cancel_at_period_end"),
        F.coalesce(F.col("b_cancelled_at"), F.col("first_cancel")).alias("cancelled_at"),
        F.coalesce(F.col("last_delete"), F.col("b_ended_at")).alias("ended_at"),
        F.coalesce(F.col("last_app.event_ts"), F.col("b_updated_at")).alias("updated_at"),
    )
    return snap, business_status(clean), rejects


def business_status(clean: DataFrame) -> DataFrame:
    """The status the last event (any subscription id) leaves on the
    business: one ``max(struct(event_ts, event_id, status))`` per business."""
    order = [F.col("event_ts"), F.coalesce("event_id", F.lit("")).alias("o"), F.col("event_id")]
    return clean.withColumn("new_status", derived_status()).groupBy("business_id").agg(
        F.max(F.struct(*order, F.col("new_status").alias("st"))).alias("m")).select(
        "business_id", F.col("m.st").alias("subscription_status"),
        F.col("m.event_id").alias("last_event_id"))


def subscriptions_placeholder(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schema("subscriptions"))


def propagate_status(businesses: DataFrame, status: DataFrame) -> DataFrame:
    """Copy the folded status onto the businesses table (new snapshot)."""
    p = status.select(F.col("business_id").alias("id"), "subscription_status")
    return apply_patch(businesses, p, ["id"], {"subscription_status": "subscription_status"},
                       patch_cols=["subscription_status"], flag="changed")


# ============================================================== streaming form
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_output_schema() -> T.StructType:
    sub = {f.name: f.dataType for f in schema("subscriptions").fields}
    fields = [T.StructField("record", T.StringType()),
              T.StructField("business_id", T.LongType())]
    fields += [T.StructField(c, sub[c]) for c in SUB_OUT if c != "business_id"]
    fields += [T.StructField("row_exists", T.BooleanType()),
               T.StructField("subscription_status", T.StringType()),
               T.StructField("event_id", T.StringType()),
               T.StructField("event_ts", T.TimestampType()),
               T.StructField("waiting", T.IntegerType())]
    return T.StructType(fields)


def _apply(st: dict, e: dict) -> None:
    """Apply one event to a business's state (the per-event rule, T2-T5)."""
    kind, ts = e["kind"], e["event_ts"]
    if kind in ("checkout", "paid"):
        new = "active"
    elif kind == "deleted":
        new = "cancelled"
    else:
        new = "cancelling" if (e["cancel_at_period_end"] and e["status"] == "active") else e["status"]
    st["business_status"], st["last_event"], st["last_ts"] = new, e["event_id"], ts
    row = st["row"]
    if kind == "checkout":
        if row is None:
            row = st["row"] = dict.fromkeys(BASE_FIELDS)
        row.update(stripe_subscription_id=e["stripe_subscription_id"],
                   stripe_customer_id=e["stripe_customer_id"], status="active",
                   amount=e["amount"], current_period_end=e["current_period_end"],
                   card_last4=e["card_last4"], card_brand=e["card_brand"],
                   payment_method="card", updated_at=ts)
        return
    if row is None or row["stripe_subscription_id"] != e["stripe_subscription_id"]:
        return
    row["status"], row["updated_at"] = new, ts
    if kind == "updated":
        row["cancel_at_period_end"] = e["cancel_at_period_end"]
        if e["cancel_at_period_end"] and row["cancelled_at"] is None:
            row["cancelled_at"] = ts
    elif kind == "deleted":
        if row["cancelled_at"] is None:
            row["cancelled_at"] = ts
        row["ended_at"] = ts


def _micros(df: DataFrame) -> DataFrame:
    """Times as microseconds, as the keyed state holds them."""
    timed = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.select(*[(F.unix_micros(c) if c in timed else F.col(c)).alias(c) for c in df.columns])


def stored_rows(subscriptions: DataFrame) -> DataFrame:
    """The current subscription row per business as the fold reads it: business_id, stored (JSON, times in microseconds)."""
    rows = _micros(current_subscriptions(subscriptions).select("business_id", *BASE_FIELDS))
    return rows.select("business_id", F.to_json(F.struct(*BASE_FIELDS), {"ignoreNullFields": "false"}).alias("stored"))


def _told(out: T.StructType) -> F.Column:
    """The fold's JSON rows as a struct of ``out``'s types (times come as microseconds)."""
    timed = {f.name for f in out.fields if isinstance(f.dataType, T.TimestampType)}
    plain = T.StructType([T.StructField(f.name, T.LongType() if f.name in timed else f.dataType) for f in out.fields])
    told = F.from_json("told", plain)
    return F.struct(*[(F.timestamp_micros(told[c]) if c in timed else told[c]).alias(c) for c in out.names])


def milliseconds(spark: SparkSession, interval: str) -> int:
    return spark.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + interval {interval})")).first()[0]


def fold_billing_stream(events: DataFrame, subscriptions: DataFrame | None = None,
                        delay: str = "1 day", remember: str | None = None,
                        stored: DataFrame | None = None) -> DataFrame:
    """Streaming fold (T1-T7), output mode ``update``.

    ``events`` is a streaming DataFrame with the billing event schema; the
    current rows of ``subscriptions`` (or ``stored``, made by ``stored_rows``)
    are the state's initial values: a join brings them with the events, and a
    business's first event sets its state, so businesses without events cost no state.  State per
    business is typed (``keyed.BillingFold``): the folded row and the events not
    yet passed by the watermark, so out-of-order arrivals inside ``delay`` fold
    in (event_ts, event_id) order and the result equals the batch fold.  An
    event-time timer folds what the watermark passes, also for a business
    without new events; ``waiting`` tells how many of a state's events the
    watermark has not passed.

    Every event that is not folded comes out as a row whose ``record`` says
    why: ``duplicate`` (T1: its id is among the business's waiting events or
    those folded in the last ``remember``, by default ``delay``), ``late`` (T7:
    at or before the folded horizon), ``unknown_type``, ``no_time`` (no event
    time: it could never be ordered) or ``no_business``.  Events without an id
    are never duplicates.  A new row's ``id`` is NULL; ``latest_states`` sets
    it.  One business's events of a micro-batch are folded by one task: bound
    the batch with the trigger.  Sets the session's state store to RocksDB,
    which keyed state with timers needs.
    """
    spark = events.sparkSession
    spark.conf.set(STATE_STORE, ROCKSDB)
    ev = events.withColumn("kind", kind_col())
    why = (F.when(F.col("kind").isNull(), "unknown_type").when(F.col("business_id").isNull(), "no_business")
           .when(F.col("event_ts").isNull(), "no_time"))
    out = stream_output_schema()
    rejects = ev.withColumn("record", why).where(F.col("record").isNotNull()).select(
        *[(F.col(f.name) if f.name in ("record", "business_id", "event_id", "event_ts") else F.lit(None))
          .cast(f.dataType).alias(f.name) for f in out.fields])
    # as microseconds the time is a plain number: late events reach the fold, which tells them
    ev = _micros(ev.where(why.isNull()).withWatermark("event_ts", delay).select("business_id", *EVENT_FIELDS))
    if stored is None:
        stored = stored_rows(subscriptions if subscriptions is not None else subscriptions_placeholder(spark))
    fold = BillingFold(_apply, milliseconds(spark, remember or delay))
    told = ev.join(stored, "business_id", "left").groupBy("business_id").transformWithStateInPandas(
        fold, "told string", "Update", "EventTime")
    return told.select(_told(out).alias("r")).select("r.*").unionByName(rejects)


def dedup_events(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """T1 for a stream that is not folded: drop repeated event ids seen within
    ``delay``.  Events without an id are never equal and all stay.  The fold
    itself tells and counts its repeats (``fold_billing_stream``)."""
    named = events.where("event_id is not null").withWatermark("event_ts", delay)
    return named.dropDuplicatesWithinWatermark(["event_id"]).unionByName(events.where("event_id is null"))


def snapshot_writer(path: str):
    """S4 for the stream: a ``foreachBatch`` function that writes each
    micro-batch's changed business states to ``{path}/states/batch={id}`` and
    the events it did not fold to ``{path}/rejects/batch={id}``.

    A replayed batch id rewrites the same folders, so the sink is idempotent.
    """
    def write(df: DataFrame, batch_id: int) -> None:
        df.persist()                     # two folders from one fold; the source can be read again
        try:
            for part, rows in (("states", F.col("record") == "state"), ("rejects", F.col("record") != "state")):
                df.where(rows).write.mode("overwrite").parquet(f"{path}/{part}/batch={batch_id}")
        finally:
            df.unpersist()
    return write


def latest_states(spark: SparkSession, path: str, subscriptions: DataFrame | None = None) -> DataFrame:
    """Current state per business from the snapshot folders: the state after
    the latest event, and of several the one written last (an older event that
    arrived in between).  With ``subscriptions`` new rows get ids above its largest."""
    df = spark.read.parquet(f"{path}/states")
    latest = latest_by_key(df, ["business_id"], [Desc("event_ts", nulls_first=False), Desc("event_id", nulls_first=False),
                                                 Desc("batch", nulls_first=False)], df.columns).drop("batch")
    if subscriptions is None:
        return latest
    new = F.when(F.col("row_exists"), above_max(subscriptions, F.col("business_id")))
    return latest.withColumn("id", F.coalesce(F.col("id"), new))


def stream_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Events the stream did not fold, counted by reason."""
    return spark.read.parquet(f"{path}/rejects").groupBy(F.col("record").alias("reason")).agg(
        F.count(F.lit(1)).alias("events"))


def compact_states(spark: SparkSession, path: str, new_path: str) -> None:
    """Write the current states alone to ``new_path`` (batch 0), so that a
    reader of a long stream need not read every batch ever written."""
    latest_states(spark, path).write.parquet(f"{new_path}/states/batch=0")


def _initial_rows(spark: SparkSession, checkpoint: str, subscriptions: DataFrame | None) -> DataFrame:
    """``stored_rows`` as of the query's first start, written beside its checkpoint."""
    path, begun = f"{checkpoint}/initial", f"{checkpoint}/initial-written"
    try:
        spark.read.schema("id long").parquet(begun)
    except AnalysisException:                              # no such folder: the first start, or one that did not get this far
        rows = stored_rows(subscriptions if subscriptions is not None else subscriptions_placeholder(spark))
        rows.write.mode("overwrite").parquet(path)
        spark.range(1).write.parquet(begun)
    return spark.read.schema("business_id long, stored string").parquet(path)


def run_billing_stream(spark: SparkSession, source: str, out: str, checkpoint: str,
                       subscriptions: DataFrame | None = None, delay: str = "1 day", remember: str | None = None,
                       fmt: str = "parquet", files_per_batch: int | None = None,
                       available_now: bool = False, name: str = "billing-fold"):
    """S2 -> T1-T7 -> S4 as one streaming query.

    Reads billing events from ``source`` files, folds them per business
    (``fold_billing_stream``) and writes changed states and rejects per
    micro-batch (``snapshot_writer``); ``latest_states`` and ``stream_rejects``
    read them.  ``checkpoint`` is the query's own folder on shared storage: a
    restart with the same folder resumes after the last finished batch, with the
    subscription rows of the first start, which are kept there (``initial``).
    Returns the started ``StreamingQuery``.
    """
    reader = spark.readStream.schema(schema("billing_events")).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stored = _initial_rows(spark, checkpoint, subscriptions)
    folded = fold_billing_stream(reader.load(source), None, delay, remember, stored)
    w = (folded.writeStream.queryName(name).outputMode("update")
         .foreachBatch(snapshot_writer(out)).option("checkpointLocation", checkpoint))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
