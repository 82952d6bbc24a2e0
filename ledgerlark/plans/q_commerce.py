"""Coupons (R27, D5, D7, M4, M19), QR codes (R28, R29, M9), bank details."""

from __future__ import annotations

from ..operators import bank, coupons as cp, qr
from ..sources import load_tables
from .params import AS_OF_EVENTS, AS_OF_ORDERS, BASE_URL
from .registry import register


def _t(spark, sf_dir):
    return load_tables(spark, sf_dir)


# ---------------------------------------------------------------- coupons
@register("coupon_usage", """
SELECT c.id, c.code, c.description, c.type, c.value, c.max_uses,
       (SELECT COUNT(*) FROM coupon_redemptions r WHERE r.coupon_id = c.id) AS times_used,
       c.is_active, c.expires_at, c.created_at
FROM coupons c
""")
def q_coupon_usage(spark, sf_dir):
    t = _t(spark, sf_dir)
    return cp.coupon_usage(t.coupons, t.coupon_redemptions)


_REASON = ("CASE WHEN a.max_uses IS NOT NULL AND s.uses >= a.max_uses THEN 'max_uses' "
           "WHEN list_contains(s.used_by, a.business_id) THEN 'already_used' ELSE 'ok' END")
# Sequential simulation: each coupon's attempts one at a time, carrying the use
# count and the businesses that redeemed it.  Independent of the Spark plan.
D5_CTES = f"""
WITH RECURSIVE
c AS (SELECT * FROM coupons QUALIFY row_number() OVER (PARTITION BY code ORDER BY id) = 1),
a AS (SELECT t.attempt_id, t.business_id, t.attempted_at, c.id AS coupon_id, c.type AS coupon_type,
             c.max_uses,
             row_number() OVER (PARTITION BY c.id ORDER BY t.attempted_at, t.business_id, t.attempt_id) AS k
      FROM coupon_attempts t JOIN c ON c.code = upper(t.code)),
init AS (SELECT c.id AS coupon_id,
                (SELECT COUNT(*) FROM coupon_redemptions r WHERE r.coupon_id = c.id) AS uses,
                COALESCE((SELECT list(DISTINCT r.business_id) FROM coupon_redemptions r
                          WHERE r.coupon_id = c.id), []::BIGINT[]) AS used_by
         FROM c WHERE c.id IN (SELECT coupon_id FROM a)),
sim(coupon_id, k, attempt_id, reason, uses_before, uses, used_by) AS (
  SELECT coupon_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR),
         CAST(NULL AS BIGINT), uses, used_by FROM init
  UNION ALL
  SELECT s.coupon_id, a.k, a.attempt_id, {_REASON}, s.uses,
         s.uses + CASE WHEN {_REASON} = 'ok' AND a.coupon_type = 'trial' THEN 1 ELSE 0 END,
         CASE WHEN {_REASON} = 'ok' AND a.coupon_type = 'trial'
              THEN list_append(s.used_by, a.business_id) ELSE s.used_by END
  FROM sim s JOIN a ON a.coupon_id = s.coupon_id AND a.k = s.k + 1
),
dec AS (
  SELECT a.attempt_id, a.business_id, a.coupon_id, a.coupon_type, a.attempted_at,
         s.uses_before, s.reason, s.reason = 'ok' AS ok,
         (s.reason = 'ok' AND a.coupon_type = 'trial') AS redeems
  FROM sim s JOIN a ON a.coupon_id = s.coupon_id AND a.k = s.k
  WHERE s.k > 0
  UNION ALL
  SELECT t.attempt_id, t.business_id, NULL, NULL, t.attempted_at, NULL, 'not_found', false, false
  FROM coupon_attempts t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.code = upper(t.code))
)
"""


@register("coupon_decisions", D5_CTES + "SELECT * FROM dec", headline=True)
def q_coupon_decisions(spark, sf_dir):
    t = _t(spark, sf_dir)
    return cp.coupon_decisions(t.coupon_attempts, t.coupons, t.coupon_redemptions).select(
        "attempt_id", "business_id", "coupon_id", "coupon_type", "attempted_at", "uses_before",
        "reason", "ok", "redeems")


@register("coupon_code_check", """
SELECT attempt_id, code, COALESCE(regexp_full_match(code, '[A-Z0-9]{4,16}'), false) AS code_ok
FROM coupon_attempts
""")
def q_coupon_code_check(spark, sf_dir):
    a = _t(spark, sf_dir).coupon_attempts
    return a.select("attempt_id", "code", cp.coupon_code_ok("code").alias("code_ok"))


@register("redeem_trials_businesses", D5_CTES + f""",
last AS (SELECT d.business_id, c.value FROM dec d JOIN coupons c ON c.id = d.coupon_id WHERE d.redeems
         QUALIFY row_number() OVER (PARTITION BY d.business_id ORDER BY d.attempted_at DESC, d.attempt_id DESC) = 1)
SELECT b.id,
       CASE WHEN l.business_id IS NOT NULL THEN 'trial' ELSE b.subscription_status END AS subscription_status,
       CASE WHEN l.business_id IS NOT NULL THEN TIMESTAMP '{AS_OF_ORDERS}' + l.value * INTERVAL 1 DAY
            ELSE b.trial_ends_at END AS trial_ends_at,
       l.business_id IS NOT NULL AS changed
FROM businesses b LEFT JOIN last l ON l.business_id = b.id
""")
def q_redeem_trials_businesses(spark, sf_dir):
    t = _t(spark, sf_dir)
    d = cp.coupon_decisions(t.coupon_attempts, t.coupons, t.coupon_redemptions)
    b, _, _ = cp.redeem_trials(d, t.businesses, t.coupons, t.coupon_redemptions, AS_OF_ORDERS)
    return b.select("id", "subscription_status", "trial_ends_at", "changed")


@register("redeem_trials_coupons", D5_CTES + """
SELECT c.id,
       CAST((SELECT COUNT(*) FROM coupon_redemptions r WHERE r.coupon_id = c.id)
            + (SELECT COUNT(*) FROM dec d WHERE d.redeems AND d.coupon_id = c.id) AS INTEGER) AS times_used
FROM coupons c
""")
def q_redeem_trials_coupons(spark, sf_dir):
    t = _t(spark, sf_dir)
    d = cp.coupon_decisions(t.coupon_attempts, t.coupons, t.coupon_redemptions)
    _, _, c = cp.redeem_trials(d, t.businesses, t.coupons, t.coupon_redemptions, AS_OF_ORDERS)
    return c.select("id", "times_used")


@register("add_coupons", """
SELECT id, code, type, is_active, times_used FROM coupons
UNION ALL
SELECT id, upper(code), type, COALESCE(is_active, true), CAST(COALESCE(times_used, 0) AS INTEGER)
FROM new_coupons
""")
def q_add_coupons(spark, sf_dir):
    t = _t(spark, sf_dir)
    return cp.add_coupons(t.coupons, t.new_coupons).select("id", "code", "type", "is_active", "times_used")


@register("deactivate_coupons", """
SELECT c.id, CASE WHEN d.coupon_id IS NOT NULL THEN false ELSE c.is_active END AS is_active,
       d.coupon_id IS NOT NULL AS changed
FROM coupons c LEFT JOIN (SELECT DISTINCT coupon_id FROM coupon_deactivations) d ON d.coupon_id = c.id
""")
def q_deactivate_coupons(spark, sf_dir):
    t = _t(spark, sf_dir)
    return cp.deactivate_coupons(t.coupons, t.coupon_deactivations).select("id", "is_active", "changed")


# ---------------------------------------------------------------- QR codes
@register("qr_codes_view", f"""
SELECT q.id, q.business_id, q.type, q.url_id, q.scans, q.created_at, q.updated_at, b.business_name,
       '{BASE_URL}/review/' || q.url_id AS review_url
FROM qr_codes q JOIN businesses b ON b.id = q.business_id
""")
def q_qr_codes_view(spark, sf_dir):
    t = _t(spark, sf_dir)
    return qr.qr_codes_view(t.qr_codes, t.businesses, BASE_URL)


QR_TARGET = ("tq AS (SELECT q.url_id, q.business_id FROM qr_codes q WHERE q.url_id IS NOT NULL "
             "QUALIFY row_number() OVER (PARTITION BY q.url_id ORDER BY q.id) = 1)")


@register("resolve_scans", f"""
WITH {QR_TARGET}
SELECT s.scan_id, s.url_id, tq.business_id, b.business_name, b.google_review_link
FROM scans s JOIN tq ON tq.url_id = s.url_id JOIN businesses b ON b.id = tq.business_id
""")
def q_resolve_scans(spark, sf_dir):
    t = _t(spark, sf_dir)
    return qr.resolve_scans(t.scans, t.qr_codes, t.businesses)[0]


@register("resolve_scans_misses", f"""
WITH {QR_TARGET}
SELECT s.scan_id, s.url_id FROM scans s
WHERE NOT EXISTS (SELECT 1 FROM tq JOIN businesses b ON b.id = tq.business_id WHERE tq.url_id = s.url_id)
""")
def q_resolve_scans_misses(spark, sf_dir):
    t = _t(spark, sf_dir)
    return qr.resolve_scans(t.scans, t.qr_codes, t.businesses)[1]


@register("upsert_qr_codes", f"""
WITH ch AS (SELECT * FROM qr_changes
            QUALIFY row_number() OVER (PARTITION BY business_id, type ORDER BY updated_at DESC, change_id DESC) = 1)
SELECT COALESCE(q.id, ch.change_id + (SELECT MAX(id) FROM qr_codes)) AS id,
       COALESCE(q.business_id, ch.business_id) AS business_id, COALESCE(q.type, ch.type) AS type,
       CASE WHEN ch.business_id IS NULL THEN q.url_id
            ELSE COALESCE(q.url_id, ch.url_id,
                          substr(sha256(concat_ws('|', CAST(ch.business_id AS VARCHAR), ch.type)), 1, 15)) END AS url_id,
       CASE WHEN q.id IS NULL THEN 0 ELSE q.scans END AS scans,
       CASE WHEN ch.business_id IS NULL THEN q.updated_at ELSE TIMESTAMP '{AS_OF_EVENTS}' END AS updated_at
FROM qr_codes q FULL OUTER JOIN ch ON q.business_id = ch.business_id AND q.type = ch.type
""")
def q_upsert_qr_codes(spark, sf_dir):
    t = _t(spark, sf_dir)
    return qr.upsert_qr_codes(t.qr_codes, t.qr_changes, AS_OF_EVENTS).select(
        "id", "business_id", "type", "url_id", "scans", "updated_at")


# ---------------------------------------------------------------- bank details
@register("bank_details_view", """
SELECT business_id, account_holder_name AS accountHolderName, transit_number AS transitNumber,
       institution_number AS institutionNumber, account_number AS accountNumber,
       bank_name AS bankName, account_type AS accountType
FROM bank_details
""")
def q_bank_details_view(spark, sf_dir):
    return bank.bank_details_view(_t(spark, sf_dir).bank_details)


BANK_ERROR = """CASE
  WHEN NOT COALESCE(regexp_full_match(transit_number, '\\d{5}'), false) THEN 'Transit number must be 5 digits'
  WHEN NOT COALESCE(regexp_full_match(institution_number, '\\d{3}'), false) THEN 'Institution number must be 3 digits'
  WHEN NOT COALESCE(regexp_full_match(account_number, '\\d{7,12}'), false) THEN 'Account number must be 7-12 digits'
END"""


@register("validate_bank_details", f"""
SELECT business_id, {BANK_ERROR} AS error, ({BANK_ERROR}) IS NULL AS valid FROM bank_changes
""")
def q_validate_bank_details(spark, sf_dir):
    return bank.validate_bank_details(_t(spark, sf_dir).bank_changes).select(
        "business_id", "error", "valid")


_BF = ["account_holder_name", "transit_number", "institution_number", "account_number",
       "bank_name", "account_type"]


@register("upsert_bank_details", f"""
WITH ch AS (SELECT * FROM bank_changes WHERE ({BANK_ERROR}) IS NULL
            QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY changed_at DESC) = 1)
SELECT COALESCE(t.business_id, ch.business_id) AS business_id,
       {", ".join(f"CASE WHEN ch.business_id IS NULL THEN t.{c} ELSE ch.{c} END AS {c}" for c in _BF)},
       CASE WHEN ch.business_id IS NULL THEN t.updated_at ELSE TIMESTAMP '{AS_OF_ORDERS}' END AS updated_at
FROM bank_details t FULL OUTER JOIN ch ON t.business_id = ch.business_id
""")
def q_upsert_bank_details(spark, sf_dir):
    t = _t(spark, sf_dir)
    return bank.upsert_bank_details(t.bank_details, t.bank_changes, AS_OF_ORDERS)
