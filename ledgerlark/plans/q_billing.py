"""Billing event fold T1-T7 (batch form) with oracles."""

from __future__ import annotations

from ..session import scratch_path
from ..sources import load_tables
from ..streaming import billing as bl
from .q_finance import CUR_SUBS
from .registry import register

_LAST = "QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY event_ts DESC, COALESCE(event_id, '') DESC) = 1"
EV_CTES = f"""
WITH {CUR_SUBS},
ev0 AS (SELECT * FROM billing_events QUALIFY event_id IS NULL OR row_number() OVER (PARTITION BY event_id ORDER BY event_ts) = 1),
ev AS (SELECT *, CASE type WHEN 'checkout.session.completed' THEN 'checkout'
                           WHEN 'customer.subscription.updated' THEN 'updated'
                           WHEN 'customer.subscription.deleted' THEN 'deleted'
                           WHEN 'invoice.payment_succeeded' THEN 'paid' END AS kind FROM ev0),
ev1 AS (SELECT *,
          CASE WHEN kind IN ('checkout', 'paid') THEN 'active' WHEN kind = 'deleted' THEN 'cancelled'
               WHEN COALESCE(cancel_at_period_end, false) AND status = 'active' THEN 'cancelling'
               ELSE status END AS new_status,
          last_value(CASE WHEN kind = 'checkout' THEN stripe_subscription_id END IGNORE NULLS)
            OVER (PARTITION BY business_id ORDER BY event_ts, COALESCE(event_id, '')
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur_sub
        FROM ev WHERE kind IS NOT NULL AND business_id IS NOT NULL),
st AS (SELECT business_id, new_status AS subscription_status, event_id AS last_event_id FROM ev1 {_LAST})
"""


def _t(spark, sf_dir):
    return load_tables(spark, sf_dir)


@register("billing_subscriptions", EV_CTES + f""",
app AS (SELECT e.* FROM ev1 e LEFT JOIN cur_subs b ON b.business_id = e.business_id
        WHERE e.kind = 'checkout' OR COALESCE(e.cur_sub, b.stripe_subscription_id) = e.stripe_subscription_id),
la AS (SELECT business_id, new_status, event_ts FROM app {_LAST}),
lu AS (SELECT business_id, cancel_at_period_end FROM app WHERE kind = 'updated' {_LAST}),
lc AS (SELECT * FROM app WHERE kind = 'checkout' {_LAST}),
fc AS (SELECT business_id, MIN(event_ts) AS t FROM app
       WHERE (kind = 'updated' AND COALESCE(cancel_at_period_end, false)) OR kind = 'deleted' GROUP BY 1),
ld AS (SELECT business_id, MAX(event_ts) AS t FROM app WHERE kind = 'deleted' GROUP BY 1),
keys AS (SELECT business_id FROM cur_subs UNION SELECT business_id FROM lc)
SELECT COALESCE(b.id, k.business_id + (SELECT MAX(id) FROM cur_subs)) AS id, k.business_id,
  CASE WHEN lc.business_id IS NOT NULL THEN lc.stripe_subscription_id ELSE b.stripe_subscription_id END AS stripe_subscription_id,
  CASE WHEN lc.business_id IS NOT NULL THEN lc.stripe_customer_id ELSE b.stripe_customer_id END AS stripe_customer_id,
  CASE WHEN la.business_id IS NOT NULL THEN la.new_status ELSE b.status END AS status,
  CASE WHEN lc.business_id IS NOT NULL THEN lc.amount ELSE b.amount END AS amount,
  CASE WHEN lc.business_id IS NOT NULL THEN lc.current_period_end ELSE b.current_period_end END AS current_period_end,
  CASE WHEN lc.business_id IS NOT NULL THEN lc.card_last4 ELSE b.card_last4 END AS card_last4,
  CASE WHEN lc.business_id IS NOT NULL THEN lc.card_brand ELSE b.card_brand END AS card_brand,
  CASE WHEN lc.business_id IS NOT NULL THEN 'card' ELSE b.payment_method END AS payment_method,
  CASE WHEN lu.business_id IS NOT NULL THEN lu.cancel_at_period_end ELSE b.cancel_at_period_end END AS cancel_at_period_end,
  COALESCE(b.cancelled_at, fc.t) AS cancelled_at,
  COALESCE(ld.t, b.ended_at) AS ended_at,
  COALESCE(la.event_ts, b.updated_at) AS updated_at
FROM keys k
LEFT JOIN cur_subs b ON b.business_id = k.business_id
LEFT JOIN la ON la.business_id = k.business_id
LEFT JOIN lu ON lu.business_id = k.business_id
LEFT JOIN lc ON lc.business_id = k.business_id
LEFT JOIN fc ON fc.business_id = k.business_id
LEFT JOIN ld ON ld.business_id = k.business_id
""", headline=True)
def q_billing_subscriptions(spark, sf_dir):
    t = _t(spark, sf_dir)
    snap, _, _ = bl.fold_billing(t.billing_events, t.subscriptions)
    return snap


@register("billing_business_status", EV_CTES + "SELECT * FROM st")
def q_billing_business_status(spark, sf_dir):
    t = _t(spark, sf_dir)
    clean, _ = bl.route_events(t.billing_events.select(*bl.STATUS_COLS))
    return bl.business_status(clean)


@register("propagate_status", EV_CTES + """
SELECT b.id, CASE WHEN st.business_id IS NOT NULL THEN st.subscription_status ELSE b.subscription_status END
         AS subscription_status,
       st.business_id IS NOT NULL AS changed
FROM businesses b LEFT JOIN st ON st.business_id = b.id
""")
def q_propagate_status(spark, sf_dir):
    t = _t(spark, sf_dir)
    clean, _ = bl.route_events(t.billing_events.select(*bl.STATUS_COLS))
    return bl.propagate_status(t.businesses, bl.business_status(clean)).select(
        "id", "subscription_status", "changed")


@register("billing_rejects", EV_CTES + """
SELECT 'duplicate' AS reason, (SELECT COUNT(event_id) - COUNT(DISTINCT event_id) FROM billing_events) AS events
UNION ALL SELECT 'unknown_type', (SELECT COUNT(*) FROM ev WHERE kind IS NULL)
UNION ALL SELECT 'no_business', (SELECT COUNT(*) FROM ev WHERE kind IS NOT NULL AND business_id IS NULL)
""")
def q_billing_rejects(spark, sf_dir):
    return bl.route_events(_t(spark, sf_dir).billing_events)[1]


@register("billing_events_from_json", """
SELECT event_id, date_trunc('second', event_ts) AS event_ts, type, stripe_subscription_id,
       stripe_customer_id, business_id, status, cancel_at_period_end, amount,
       date_trunc('second', current_period_end) AS current_period_end,
       CASE WHEN amount % 4 IS DISTINCT FROM 2 THEN card_last4 END AS card_last4,
       CASE WHEN amount % 4 IS DISTINCT FROM 2 THEN card_brand END AS card_brand
FROM billing_events
""")
def q_billing_events_from_json(spark, sf_dir):
    """Provider JSON bodies, rendered from the billing events in the
    provider's nested shape (times as whole epoch seconds), parsed back by
    ``parse_provider_events``."""
    return bl.parse_provider_events(_bodies(_t(spark, sf_dir).billing_events))


def _bodies(e):
    """The events as JSON bodies in the provider's nested shape."""
    from pyspark.sql import functions as F
    card_type = "struct<last4: string, brand: string>"
    # the card is the payment method, the default source, or there is none
    way, card = F.col("amount") % 4, F.struct(F.col("card_last4").alias("last4"), F.col("card_brand").alias("brand"))
    method = (F.when(way == 1, F.struct(F.lit("link").alias("type"), F.lit(None).cast(card_type).alias("card")))
              .when(way == 2, F.lit(None)).otherwise(F.struct(F.lit("card").alias("type"), card.alias("card"))))
    source = F.struct(F.when(way == 1, "card").otherwise("bank_account").alias("object"),
                      F.when(way == 1, F.col("card_last4")).otherwise("9999").alias("last4"),
                      F.when(way == 1, F.col("card_brand")).alias("brand"))
    is_sess = F.col("type").isin("checkout.session.completed", "invoice.payment_succeeded")
    obj = F.struct(
        F.when(is_sess, F.concat(F.lit("cs_"), F.col("event_id").cast("string")))
        .otherwise(F.col("stripe_subscription_id")).alias("id"),
        F.col("stripe_customer_id").alias("customer"),
        F.when(is_sess, F.col("stripe_subscription_id")).alias("subscription"),
        "status", "cancel_at_period_end",
        F.unix_seconds("current_period_end").alias("current_period_end"),
        F.when(F.col("business_id").isNotNull(),
               F.create_map(F.lit("business_id"), F.col("business_id").cast("string"))).alias("metadata"),
        F.struct(F.array(F.struct(F.struct(F.col("amount").alias("unit_amount")).alias("price")))
                 .alias("data")).alias("items"),
        method.alias("default_payment_method"), source.alias("default_source"))
    return e.select(F.to_json(F.struct(
        F.col("event_id").alias("id"), "type",
        F.unix_seconds("event_ts").alias("created"),
        F.struct(obj.alias("object")).alias("data"))).alias("body"), "amount")


# bodies cut off in the middle, of another shape or missing; bodies that name no event id
_BAD = "CASE WHEN amount % 9 IN (4, 6, 7) THEN 'malformed' WHEN amount % 9 = 5 OR event_id IS NULL THEN 'no_id' ELSE 'ok' END"


def _intake(spark, sf_dir):
    from pyspark.sql import functions as F
    e, bad = _t(spark, sf_dir).billing_events, F.col("amount") % 9
    e = e.withColumn("event_id", F.when(F.coalesce(bad == 5, F.lit(False)), F.lit(None)).otherwise(F.col("event_id")))
    raw = _bodies(e).select(F.when(bad == 4, F.expr("left(body, length(body) div 2)")).when(bad == 6, F.lit("[1, 2]"))
                            .when(bad == 7, F.lit(None)).otherwise(F.col("body")).alias("body"))
    path = scratch_path(spark, "billing-bodies")          # bodies as they are delivered: files
    raw.write.parquet(path)
    return bl.intake_provider_events(spark.read.schema("body string").parquet(path))


@register("billing_quarantine", f"SELECT {_BAD} AS reason, COUNT(*) AS bodies FROM billing_events GROUP BY 1 HAVING reason <> 'ok'")
def q_billing_quarantine(spark, sf_dir):
    """Bodies that are not folded, by reason."""
    return _intake(spark, sf_dir)[1].groupBy("reason").agg({"bodies": "sum"}).withColumnRenamed("sum(bodies)", "bodies")


@register("billing_intake_status", EV_CTES.replace("FROM billing_events QUALIFY",
          f"FROM (SELECT *, {_BAD} AS reason FROM billing_events) WHERE reason = 'ok' QUALIFY") + "SELECT * FROM st")
def q_billing_intake_status(spark, sf_dir):
    """S2 -> T6: the statuses that the accepted bodies leave on the businesses."""
    clean, _ = bl.route_events(_intake(spark, sf_dir)[0])
    return bl.business_status(clean)




def _streamed(spark, sf_dir):
    """The billing events as files, folded by the stream to the end; its output folder."""
    t = _t(spark, sf_dir)
    source, out, checkpoint = (scratch_path(spark, f"billing-{k}") for k in ("source", "out", "checkpoint"))
    cores = spark.sparkContext.defaultParallelism          # two micro-batches, of two thirds and a third
    t.billing_events.repartition(3 * cores).write.parquet(source)
    bl.run_billing_stream(spark, source, out, checkpoint, t.subscriptions, delay="3650 days",
                          files_per_batch=2 * cores, available_now=True).awaitTermination()
    return out


@register("billing_stream_states", EV_CTES + "SELECT * FROM st")
def q_billing_stream_states(spark, sf_dir):
    """T1-T7 as a stream: the status that the last event leaves on each business."""
    states = bl.latest_states(spark, _streamed(spark, sf_dir))
    return states.select("business_id", "subscription_status", states["event_id"].alias("last_event_id"))


@register("billing_stream_rejects", EV_CTES + """,
raw AS (SELECT e.*, (SELECT MIN(x.kind) FROM ev x WHERE x.type = e.type) AS kind FROM billing_events e)
SELECT 'unknown_type' AS reason, COUNT(*) AS events FROM raw WHERE kind IS NULL
UNION ALL SELECT 'no_business', COUNT(*) FROM raw WHERE kind IS NOT NULL AND business_id IS NULL
UNION ALL SELECT 'duplicate', COUNT(event_id) - COUNT(DISTINCT event_id) FROM raw
          WHERE kind IS NOT NULL AND business_id IS NOT NULL
""")
def q_billing_stream_rejects(spark, sf_dir):
    """Events the stream does not fold, by reason."""
    return bl.stream_rejects(spark, _streamed(spark, sf_dir))
