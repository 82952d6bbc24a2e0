"""Declared schemas of the domain tables.

Money is ``decimal(18,2)`` inside the library; subscription and billing
amounts are integer cents as the payment provider sends them.  Timestamps
are ``TimestampType`` in a UTC session.  No password column exists anywhere.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "bool": T.BooleanType(),
    "ts": T.TimestampType(),
    "money": MONEY,
    "double": T.DoubleType(),
    "strings": T.ArrayType(T.StringType()),
}

# DuckDB spelling of the same types, used when the oracle builds the tables.
DUCK_TYPES = {
    "long": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "bool": "BOOLEAN",
    "ts": "TIMESTAMP",
    "money": "DECIMAL(18,2)",
    "double": "DOUBLE",
    "strings": "VARCHAR[]",
}

# Column lists: (name, short type).  Order is the declared column order.
COLUMNS: dict[str, list[tuple[str, str]]] = {
    "businesses": [
        ("id", "long"), ("business_name", "string"), ("owner_name", "string"),
        ("email", "string"), ("phone", "string"), ("address", "string"),
        ("google_review_link", "string"), ("referral_code", "string"),
        ("created_at", "ts"), ("updated_at", "ts"), ("onboarding_completed", "bool"),
        ("is_salesperson", "bool"), ("is_admin", "bool"), ("subscription_status", "string"),
        ("email_verified", "bool"), ("trial_reviews_remaining", "int"),
        ("trial_started_at", "ts"), ("trial_ends_at", "ts"),
        ("total_referral_earnings", "money"), ("subscription_amount", "money"),
    ],
    "subscriptions": [
        ("id", "long"), ("business_id", "long"), ("payment_method", "string"),
        ("status", "string"), ("created_at", "ts"), ("updated_at", "ts"),
        ("stripe_customer_id", "string"), ("stripe_subscription_id", "string"),
        ("amount", "long"), ("current_period_end", "ts"), ("card_last4", "string"),
        ("card_brand", "string"), ("cancel_at_period_end", "bool"),
        ("cancelled_at", "ts"), ("ended_at", "ts"),
    ],
    "reviews": [
        ("id", "long"), ("business_id", "long"), ("customer_name", "string"),
        ("rating", "int"), ("comment", "string"), ("reply", "string"),
        ("replied_at", "ts"), ("source", "string"), ("created_at", "ts"),
        ("improvement_areas", "strings"), ("feedback", "string"),
    ],
    "qr_codes": [
        ("id", "long"), ("business_id", "long"), ("type", "string"), ("url_id", "string"),
        ("scans", "int"), ("created_at", "ts"), ("updated_at", "ts"),
    ],
    "payments": [
        ("id", "long"), ("business_id", "long"), ("amount", "money"), ("created_at", "ts"),
    ],
    "referrals": [
        ("id", "long"), ("referrer_id", "long"), ("referred_business_id", "long"),
        ("status", "string"), ("commission_paid", "bool"), ("commission_amount", "money"),
        ("created_at", "ts"),
    ],
    "referral_earnings": [
        ("id", "long"), ("referral_id", "long"), ("seller_id", "long"),
        ("business_id", "long"), ("amount", "money"), ("status", "string"),
        ("month", "ts"), ("created_at", "ts"),
    ],
    "commissions": [
        ("payment_id", "long"), ("referral_id", "long"), ("amount", "money"),
        ("created_at", "ts"),
    ],
    "coupons": [
        ("id", "long"), ("code", "string"), ("description", "string"), ("type", "string"),
        ("value", "int"), ("max_uses", "int"), ("times_used", "int"),
        ("is_active", "bool"), ("expires_at", "ts"), ("created_at", "ts"),
    ],
    "coupon_redemptions": [("coupon_id", "long"), ("business_id", "long")],
    "verification_tokens": [
        ("business_id", "long"), ("token", "string"), ("type", "string"),
        ("expires_at", "ts"),
    ],
    "bank_details": [
        ("business_id", "long"), ("account_holder_name", "string"),
        ("transit_number", "string"), ("institution_number", "string"),
        ("account_number", "string"), ("bank_name", "string"),
        ("account_type", "string"), ("updated_at", "ts"),
    ],
    "bank_changes": [
        ("business_id", "long"), ("account_holder_name", "string"),
        ("transit_number", "string"), ("institution_number", "string"),
        ("account_number", "string"), ("bank_name", "string"),
        ("account_type", "string"), ("changed_at", "ts"),
    ],
    "qr_changes": [
        ("change_id", "long"), ("business_id", "long"), ("type", "string"),
        ("url_id", "string"), ("updated_at", "ts"),
    ],
    "billing_events": [
        ("event_id", "string"), ("event_ts", "ts"), ("type", "string"),
        ("stripe_subscription_id", "string"), ("stripe_customer_id", "string"),
        ("business_id", "long"), ("status", "string"), ("cancel_at_period_end", "bool"),
        ("amount", "long"), ("current_period_end", "ts"), ("card_last4", "string"),
        ("card_brand", "string"),
    ],
    "signups": [
        ("signup_id", "long"), ("business_name", "string"), ("owner_name", "string"),
        ("email", "string"), ("phone", "string"), ("address", "string"),
        ("google_review_link", "string"), ("is_salesperson", "bool"),
        ("referral_code", "string"), ("created_at", "ts"),
    ],
}


def schema(table: str) -> T.StructType:
    """Spark StructType of a domain table."""
    return T.StructType([T.StructField(n, _TYPES[t], True) for n, t in COLUMNS[table]])


def spark_type(short: str) -> T.DataType:
    return _TYPES[short]
