"""Driver tables -> domain tables.

Each adapter is one FROM (optionally a two-table equi join), one optional WHERE and
one SQL expression per column, written in the SQL subset that both Spark and DuckDB
accept.  Spark runs it with ``selectExpr``; the oracle runs the same text as a CTE,
so both engines start from identical input.  Adapters only shape stand-in rows
(which rows have partners, which hold NULLs); they do none of an operator's work.
Columns not listed are NULL of the declared type.

Order-based tables use ``as_of = 2001-08-01``; event-based ones ``2024-01-31``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import COLUMNS, DUCK_TYPES


@dataclass(frozen=True)
class Adapter:
    table: str
    source: str                       # driver table
    cols: dict[str, str]
    where: str | None = None
    join: tuple[str, str] | None = None   # (driver table, ON condition)
    distinct: bool = False
    # more rows of the same source: (columns that differ, WHERE)
    also: tuple[dict[str, str], str] | None = None


_ORD = "orders"
_LI_JOIN = ("orders", "l_orderkey = o_orderkey")

ADAPTERS: dict[str, Adapter] = {a.table: a for a in [
    # ---------------------------------------------------------------- FIXTURES.md §2
    Adapter("businesses", "customer", {
        "id": "c_custkey",
        "business_name": "c_name",
        "email": "CONCAT('b', CAST(c_custkey AS STRING), '@example.com')",
        "address": "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CONCAT('Street ', CAST(c_custkey AS STRING)) END",
        "google_review_link": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CONCAT('https://example.com/r/', CAST(c_custkey AS STRING)) END",
        # two salespeople share a code
        "referral_code": "CASE WHEN c_custkey % 10 = 0 THEN CONCAT('REF', CAST(c_custkey - c_custkey % 20 AS STRING)) END",
        "is_salesperson": "c_custkey % 10 = 0",
        "is_admin": "CASE WHEN c_custkey % 97 = 1 THEN NULL ELSE c_custkey % 50 = 3 END",
        "onboarding_completed": "c_custkey % 3 <> 0",
        "subscription_status": "CASE c_custkey % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'cancelling' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'trial' WHEN 4 THEN 'pending' END",
        "subscription_amount": "CAST(ABS(c_acctbal) AS DECIMAL(18,2))",
        "trial_reviews_remaining": "CASE WHEN c_custkey % 13 = 5 THEN NULL ELSE CAST(c_custkey % 12 AS INT) END",
        "trial_started_at": "CASE WHEN c_custkey % 6 = 3 THEN TIMESTAMP '2001-07-10 00:00:00' + (c_custkey % 25) * INTERVAL '1' DAY END",
        "created_at": "TIMESTAMP '1995-01-01 00:00:00' + (c_custkey % 1000) * INTERVAL '1' DAY",
        # not in FIXTURES: owner and earnings so profile / card reports carry values
        "owner_name": "CONCAT('Owner ', CAST(c_custkey AS STRING))",
        "total_referral_earnings": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_acctbal AS DECIMAL(18,2)) END",
    }),
    Adapter("subscriptions", "customer", {
        "id": "c_custkey",
        "business_id": "c_custkey",
        "status": "CASE c_custkey % 7 WHEN 3 THEN 'cancelling' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'suspended' ELSE 'active' END",
        "amount": "1000 + (c_custkey % 50) * 100",
        "stripe_subscription_id": "CONCAT('sub_', CAST(c_custkey AS STRING))",
        "current_period_end": "TIMESTAMP '2001-07-01 00:00:00' + (c_custkey % 60) * INTERVAL '1' DAY",
        "card_last4": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '4242' END",
        "card_brand": "CASE WHEN c_custkey % 2 = 0 THEN 'visa' ELSE 'american express' END",
        "payment_method": "'card'",
    }, where="c_custkey % 5 <> 4",
        # a newer, second subscription of some businesses
        also=({"id": "1000000 + c_custkey",
               "status": "CASE c_custkey % 3 WHEN 0 THEN 'active' ELSE 'cancelled' END",
               "amount": "5000 + c_custkey % 7",
               "stripe_subscription_id": "CONCAT('sub_', CAST(c_custkey AS STRING), '_b')"}, "c_custkey % 6 = 2")),
    Adapter("payments", _ORD, {
        "id": "o_orderkey",
        "business_id": "o_custkey",
        "amount": "CAST(o_totalprice AS DECIMAL(18,2))",
        "created_at": "CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderdate END",
    }, where="o_custkey % 11 <> 0"),
    Adapter("referrals", "customer", {
        "id": "c_custkey",
        "referrer_id": "c_custkey - c_custkey % 10",
        "referred_business_id": "c_custkey",
        "status": "CASE WHEN c_custkey % 4 = 1 THEN 'pending' ELSE 'active' END",
        "commission_paid": "c_custkey % 2 = 0",
        "commission_amount": "CAST(c_custkey AS DECIMAL(18,2))",
        "created_at": "CASE WHEN c_custkey % 53 <> 1 THEN TIMESTAMP '1996-01-01 00:00:00' + (c_custkey % 1000) * INTERVAL '1' DAY END",
    }, where="c_custkey % 10 <> 0 AND c_custkey % 100 < 90"),
    Adapter("referral_earnings", _ORD, {
        "id": "o_orderkey",
        "referral_id": "o_custkey",
        "seller_id": "o_custkey - o_custkey % 10",
        "business_id": "o_custkey",
        "amount": "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.2 AS DECIMAL(3,1)) AS DECIMAL(18,2))",
        "status": "CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE 'paid' END",
        "month": "CASE WHEN o_orderkey % 50 = 0 THEN TIMESTAMP '2001-08-01 00:00:00' ELSE DATE_TRUNC('month', CAST(o_orderdate AS TIMESTAMP)) END",
        "created_at": "o_orderdate",
    }, where="o_custkey % 10 <> 0"),
    Adapter("commissions", "lineitem", {
        "payment_id": "l_orderkey",
        "referral_id": "o_custkey",
        "amount": "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2))",
        "created_at": "l_shipdate",
    }, join=_LI_JOIN),
    Adapter("reviews", "events", {
        "id": "event_id",
        "business_id": "user_id",
        "customer_name": "CONCAT('Guest ', CAST(event_id AS STRING))",
        "rating": "CASE WHEN event_id % 37 <> 0 THEN CAST(1 + event_id % 5 AS INT) END",
        "comment": "props",
        "source": "event_type",
        "created_at": "CASE WHEN event_id % 41 <> 0 THEN ts END",
    }),
    Adapter("qr_changes", "events", {
        "change_id": "event_id",
        "business_id": "user_id",
        "type": "event_type",
        "url_id": "CASE WHEN event_id % 5 <> 0 THEN CONCAT('u', CAST(event_id AS STRING)) END",
        "updated_at": "ts",
    }),
    Adapter("coupons", "part", {
        "id": "p_partkey",
        # some coupons repeat their predecessor's code
        "code": "CONCAT('C', CAST(p_partkey - CASE WHEN p_partkey % 30 = 0 THEN 1 ELSE 0 END AS STRING))",
        "type": "CASE WHEN p_size % 2 = 0 THEN 'trial' ELSE 'discount' END",
        "value": "p_size",
        "max_uses": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END",
        "is_active": "p_partkey % 6 <> 0",
        "created_at": "TIMESTAMP '2000-01-01 00:00:00' + (p_partkey % 300) * INTERVAL '1' DAY",
        "description": "p_name",
        "times_used": "CAST(p_size % 3 AS INT)",
        "expires_at": "CASE WHEN p_partkey % 4 = 0 THEN TIMESTAMP '2001-01-01 00:00:00' END",
    }),
    # FIXTURES.md's redemption_attempts (lineitem x orders), split in time:
    # attempts before 1998 are history (their distinct pairs are the
    # redemptions); later ones, with a typed code, are the batch D5 decides.
    Adapter("coupon_redemptions", "lineitem", {
        "coupon_id": "l_partkey",
        "business_id": "o_custkey",
    }, join=_LI_JOIN, where="l_shipdate < TIMESTAMP '1998-01-01 00:00:00'", distinct=True),
    Adapter("coupon_attempts", "lineitem", {
        # lineitem has no unique key of its own; these four columns are unique
        "attempt_id": "CONCAT(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING))",
        "code": "CASE WHEN l_partkey % 50 = 7 THEN CONCAT('X', CAST(l_partkey AS STRING)) WHEN l_linenumber % 2 = 0 THEN CONCAT('c', CAST(l_partkey AS STRING)) ELSE CONCAT('C', CAST(l_partkey AS STRING)) END",
        "business_id": "o_custkey",
        "attempted_at": "l_shipdate",
    }, join=_LI_JOIN, where="l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'"),
    Adapter("bank_changes", "supplier", {
        "business_id": "s_suppkey",
        "transit_number": "CASE WHEN s_suppkey % 7 = 0 THEN '1234' ELSE '12345' END",
        "institution_number": "CASE WHEN s_suppkey % 5 = 0 THEN '12a' ELSE '001' END",
        "account_number": "CASE WHEN s_suppkey % 3 = 0 THEN '123456' ELSE '1234567' END",
        "account_holder_name": "s_name",
        "bank_name": "CONCAT('Bank ', CAST(s_nationkey AS STRING))",
        "account_type": "CASE WHEN s_suppkey % 2 = 0 THEN 'checking' ELSE 'savings' END",
        "changed_at": "TIMESTAMP '2001-08-01 00:00:00'",
    }),
    Adapter("verification_tokens", "events", {
        "business_id": "user_id",
        "token": "CONCAT('t', CAST(event_id AS STRING))",
        "type": "CASE event_type WHEN 'signup' THEN 'email' ELSE 'password_reset' END",
        "expires_at": "ts + CASE event_type WHEN 'signup' THEN 24 ELSE 1 END * INTERVAL '1' HOUR",
    }, where="event_type IN ('signup', 'view')"),
    Adapter("billing_events", "events", {
        # ids that end in letters or share their trailing digits; some events have none
        "event_id": "CASE WHEN event_id % 50 <> 9 THEN CONCAT('evt_', CAST(event_id AS STRING), CASE event_id % 3 WHEN 0 THEN 'Qx7' WHEN 1 THEN 'k' ELSE '' END) END",
        "event_ts": "ts",
        "type": "CASE event_type WHEN 'signup' THEN 'checkout.session.completed' WHEN 'click' THEN 'customer.subscription.updated' WHEN 'error' THEN 'customer.subscription.deleted' WHEN 'purchase' THEN 'invoice.payment_succeeded' ELSE 'ignored.type' END",
        "stripe_subscription_id": "CONCAT('sub_', CAST(user_id AS STRING), CASE WHEN event_id % 4 = 1 THEN '_b' ELSE '' END)",
        "stripe_customer_id": "CONCAT('cus_', CAST(user_id AS STRING))",
        "business_id": "CASE WHEN user_id % 20 = 7 THEN NULL ELSE user_id END",
        "status": "CASE WHEN event_id % 7 = 0 THEN 'past_due' ELSE 'active' END",
        "cancel_at_period_end": "event_id % 2 = 0",
        "amount": "CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT)",
        "current_period_end": "ts + INTERVAL '30' DAY",
        "card_last4": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE '4242' END",
        "card_brand": "CASE WHEN event_id % 2 = 0 THEN 'visa' ELSE 'mastercard' END",
    }, also=({}, "event_id % 40 = 0")),                    # events delivered twice
    Adapter("presented_tokens", "events", {
        "request_id": "event_id",
        "token": "CONCAT('t', CAST(event_id AS STRING))",
        "type": "CASE WHEN event_id % 5 = 0 THEN 'password_reset' ELSE 'email' END",
    }, where="event_type IN ('signup', 'view', 'click')"),
    # ------------------------------------------------ change sets for the batch jobs
    Adapter("qr_codes", "customer", {
        "id": "c_custkey",
        "business_id": "c_custkey",
        "type": "CASE c_custkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'table' END",
        "url_id": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CONCAT('q', CAST(c_custkey AS STRING)) END",
        "scans": "CAST(c_custkey % 100 AS INT)",
        "created_at": "TIMESTAMP '2000-01-01 00:00:00'",
    }),
    Adapter("scans", "events", {
        "scan_id": "event_id",
        "url_id": "CASE WHEN event_id % 2 = 0 THEN CONCAT('q', CAST(user_id AS STRING)) ELSE CONCAT('x', CAST(event_id AS STRING)) END",
        "scanned_at": "ts",
    }, where="event_type = 'purchase'"),
    Adapter("bank_details", "supplier", {
        "business_id": "s_suppkey",
        "account_holder_name": "CONCAT('Old ', s_name)",
        "transit_number": "'54321'",
        "institution_number": "'002'",
        "account_number": "'7654321'",
        "bank_name": "'Old bank'",
        "account_type": "'checking'",
        "updated_at": "TIMESTAMP '2000-01-01 00:00:00'",
    }, where="s_suppkey % 2 = 0"),
    Adapter("review_replies", "events", {
        "review_id": "event_id",
        "business_id": "CASE WHEN event_id % 9 = 0 THEN user_id + 1 ELSE user_id END",
        "reply": "CONCAT('Thanks for ', event_type)",
        "requested_at": "ts + INTERVAL '1' HOUR",
    }, where="event_type = 'click'"),
    Adapter("review_surveys", "events", {
        "review_id": "event_id",
        "business_id": "CASE WHEN event_id % 11 = 0 THEN user_id + 1 ELSE user_id END",
        "areas": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE CONCAT('speed,', event_type) END",
        "feedback": "CONCAT('Feedback ', CAST(event_id AS STRING))",
        "submitted_at": "ts + INTERVAL '2' HOUR",
    }, where="event_type = 'view'"),
    Adapter("new_reviews", _ORD, {
        "id": "o_orderkey",
        "business_id": "o_custkey",
        "customer_name": "CONCAT('Buyer ', CAST(o_orderkey AS STRING))",
        "rating": "CAST(1 + o_orderkey % 5 AS INT)",
        "comment": "o_orderpriority",
        "source": "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'qr' END",
        "created_at": "o_orderdate",
    }, where="o_orderstatus = 'O'"),
    Adapter("suspend_requests", _ORD, {
        "business_id": "o_custkey",
        "requested_at": "o_orderdate",
    }, where="o_orderpriority = '1-URGENT'"),
    Adapter("cancel_requests", _ORD, {
        "business_id": "o_custkey",
        "requested_at": "o_orderdate",
    }, where="o_orderpriority = '2-HIGH'"),
    Adapter("trial_requests", "events", {
        "business_id": "user_id",
        "requested_at": "ts",
    }, where="event_type = 'signup'"),
    Adapter("review_attempts", "events", {
        "attempt_id": "event_id",
        "business_id": "user_id",
        "attempted_at": "ts",
    }, where="event_type IN ('view', 'click')"),
    Adapter("profile_patches", "customer", {
        "business_id": "c_custkey",
        "business_name": "UPPER(c_name)",
        "owner_name": "CONCAT('New owner ', CAST(c_custkey AS STRING))",
        "phone": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CONCAT('555-', CAST(c_custkey AS STRING)) END",
        "address": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CONCAT('Avenue ', CAST(c_custkey AS STRING)) END",
        "google_review_link": "CONCAT('https://example.com/g/', CAST(c_custkey AS STRING))",
        "requested_at": "TIMESTAMP '2001-08-01 00:00:00'",
    }, where="c_mktsegment = 'BUILDING'"),
    Adapter("onboarding_requests", "customer", {
        "business_id": "c_custkey",
        "payment_method": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'paypal' END",
        "requested_at": "TIMESTAMP '2001-08-01 00:00:00'",
    }, where="c_mktsegment = 'MACHINERY'"),
    Adapter("signups", _ORD, {
        "signup_id": "o_orderkey",
        "business_name": "CONCAT('Shop ', CAST(o_orderkey AS STRING))",
        "owner_name": "CONCAT('Founder ', CAST(o_custkey AS STRING))",
        "email": "CASE WHEN o_orderkey % 4 = 0 THEN CONCAT('b', CAST(o_custkey AS STRING), '@example.com') ELSE CONCAT('new', CAST(o_custkey AS STRING), '@example.com') END",
        "is_salesperson": "o_orderkey % 9 = 0",
        "referral_code": "CASE o_orderkey % 3 WHEN 0 THEN CONCAT('REF', CAST(o_custkey - o_custkey % 10 AS STRING)) WHEN 1 THEN CONCAT('NOPE', CAST(o_custkey AS STRING)) END",
        "created_at": "o_orderdate",
    }, where="o_orderpriority = '5-LOW'"),
    Adapter("new_coupons", "supplier", {
        "id": "1000000000 + s_suppkey",
        "code": "CONCAT('new', CAST(s_suppkey AS STRING))",
        "description": "s_name",
        "type": "CASE WHEN s_suppkey % 2 = 0 THEN 'trial' ELSE 'discount' END",
        "value": "CAST(s_suppkey % 30 + 1 AS INT)",
        "max_uses": "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey % 10 + 1 AS INT) END",
        "created_at": "TIMESTAMP '2001-08-01 00:00:00'",
    }),
    Adapter("coupon_deactivations", "lineitem", {
        "coupon_id": "l_partkey",
        "requested_at": "l_shipdate",
    }, where="l_returnflag = 'R'"),
]}

# Types of change-set columns that are not domain tables in schemas.COLUMNS.
EXTRA_TYPES: dict[str, dict[str, str]] = {
    "coupon_attempts": {"attempt_id": "string", "code": "string", "business_id": "long", "attempted_at": "ts"},
    "presented_tokens": {"request_id": "long", "token": "string", "type": "string"},
    "scans": {"scan_id": "long", "url_id": "string", "scanned_at": "ts"},
    "review_replies": {"review_id": "long", "business_id": "long", "reply": "string", "requested_at": "ts"},
    "review_surveys": {"review_id": "long", "business_id": "long", "areas": "string", "feedback": "string",
                       "submitted_at": "ts"},
    "new_reviews": {"id": "long", "business_id": "long", "customer_name": "string", "rating": "int",
                    "comment": "string", "source": "string", "created_at": "ts"},
    "suspend_requests": {"business_id": "long", "requested_at": "ts"},
    "cancel_requests": {"business_id": "long", "requested_at": "ts"},
    "trial_requests": {"business_id": "long", "requested_at": "ts"},
    "review_attempts": {"attempt_id": "long", "business_id": "long", "attempted_at": "ts"},
    "profile_patches": {"business_id": "long", "business_name": "string", "owner_name": "string",
                        "phone": "string", "address": "string", "google_review_link": "string",
                        "requested_at": "ts"},
    "onboarding_requests": {"business_id": "long", "payment_method": "string", "requested_at": "ts"},
    "new_coupons": {n: t for n, t in COLUMNS["coupons"]},
    "coupon_deactivations": {"coupon_id": "long", "requested_at": "ts"},
}

_SPARK_CAST = {"long": "BIGINT", "int": "INT", "string": "STRING", "bool": "BOOLEAN",
               "ts": "TIMESTAMP", "money": "DECIMAL(18,2)", "double": "DOUBLE",
               "strings": "ARRAY<STRING>"}


def columns_of(table: str) -> list[tuple[str, str]]:
    if table in EXTRA_TYPES:
        return list(EXTRA_TYPES[table].items())
    return COLUMNS[table]


def _exprs(table: str, cast_names: dict[str, str], differing: dict[str, str] | None = None) -> list[str]:
    cols = ADAPTERS[table].cols | (differing or {})
    out = []
    for name, short in columns_of(table):
        src = cols.get(name, "NULL")
        out.append(f"CAST({src} AS {cast_names[short]}) AS {name}")
    return out


def adapter_frame(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Build one domain table from the driver parquet files under ``sf_dir``."""
    a = ADAPTERS[table]
    df = spark.read.parquet(f"{sf_dir}/{a.source}.parquet")
    if a.join is not None:
        other, cond = a.join
        df = df.join(spark.read.parquet(f"{sf_dir}/{other}.parquet"), F.expr(cond), "inner")
    rows = df.where(a.where) if a.where else df
    rows = rows.selectExpr(*_exprs(table, _SPARK_CAST))
    if a.also:
        rows = rows.unionByName(df.where(a.also[1]).selectExpr(*_exprs(table, _SPARK_CAST, a.also[0])))
    df = rows
    if a.distinct:
        df = df.distinct()
    return df


def adapter_sql(table: str) -> str:
    """The same adapter as a DuckDB SELECT over the driver views."""
    a = ADAPTERS[table]
    sel = ", ".join(_exprs(table, DUCK_TYPES))
    frm = a.source
    if a.join is not None:
        frm = f"{a.source} JOIN {a.join[0]} ON {a.join[1]}"
    where = f" WHERE {a.where}" if a.where else ""
    distinct = "DISTINCT " if a.distinct else ""
    more = ""
    if a.also:
        more = f" UNION ALL SELECT {', '.join(_exprs(table, DUCK_TYPES, a.also[0]))} FROM {frm} WHERE {a.also[1]}"
    return f"SELECT {distinct}{sel} FROM {frm}{where}{more}"
