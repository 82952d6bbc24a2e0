"""Finance reports R16-R19 with their oracles."""

from __future__ import annotations

from ..operators import finance
from ..sources import load_tables
from .params import AS_OF_ORDERS, RANGE_END, RANGE_START
from .registry import register

CUR_SUBS = ("cur_subs AS (SELECT * FROM subscriptions WHERE business_id IS NOT NULL "
            "QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY id DESC) = 1)")


def money(expr: str) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), 2)"


@register("financial_totals", f"""
WITH {CUR_SUBS}
SELECT
  {money("COALESCE((SELECT SUM(p.amount) FROM payments p WHERE p.business_id IN (SELECT id FROM businesses)), 0)")} AS total_revenue,
  {money("COALESCE((SELECT SUM(re.amount) FROM referral_earnings re WHERE re.seller_id IN (SELECT id FROM businesses)), 0)")} AS total_commissions,
  (SELECT COUNT(DISTINCT b.id) FROM businesses b JOIN cur_subs s ON s.business_id = b.id WHERE s.status = 'active') AS active_businesses,
  (SELECT COUNT(DISTINCT id) FROM businesses WHERE is_salesperson) AS total_salespeople
""")
def q_financial_totals(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return finance.financial_totals(t.businesses, t.subscriptions, t.payments, t.referral_earnings)


@register("financial_totals_as_written", f"""
WITH subs AS (SELECT business_id, COUNT(*) AS k, BOOL_OR(status = 'active') AS live FROM subscriptions GROUP BY ALL),
pay AS (SELECT business_id, COUNT(*) AS k, SUM(amount) AS total FROM payments GROUP BY ALL),
earn AS (SELECT seller_id, COUNT(*) AS k, SUM(amount) AS total FROM referral_earnings GROUP BY ALL)
SELECT {money("COALESCE(SUM(pay.total * COALESCE(subs.k, 1) * COALESCE(earn.k, 1)), 0)")} AS total_revenue,
       {money("COALESCE(SUM(earn.total * COALESCE(subs.k, 1) * COALESCE(pay.k, 1)), 0)")} AS total_commissions,
       COUNT(*) FILTER (WHERE live) AS active_businesses, COUNT(*) FILTER (WHERE is_salesperson) AS total_salespeople
FROM businesses LEFT JOIN subs ON subs.business_id = id LEFT JOIN pay ON pay.business_id = id
LEFT JOIN earn ON seller_id = id
""")
def q_financial_totals_as_written(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return finance.financial_totals(t.businesses, t.subscriptions, t.payments,
                                    t.referral_earnings, fanout="as_written")


@register("monthly_financials", f"""
WITH last AS (SELECT date_trunc('month', TIMESTAMP '{AS_OF_ORDERS}') AS m),
spine AS (SELECT UNNEST(generate_series(m - INTERVAL 11 MONTH, m, INTERVAL 1 MONTH)) AS month FROM last),
got AS (SELECT date_trunc('month', created_at) AS month, SUM(amount) AS total FROM payments GROUP BY ALL),
owed AS (SELECT date_trunc('month', created_at) AS month, SUM(amount) AS total FROM referral_earnings GROUP BY ALL)
SELECT CAST(month AS TIMESTAMP) AS month, {money("COALESCE(got.total, 0)")} AS revenue,
       {money("COALESCE(owed.total, 0)")} AS commissions
FROM spine LEFT JOIN got USING (month) LEFT JOIN owed USING (month)
""", headline=True)
def q_monthly_financials(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return finance.monthly_financials(spark, t.payments, t.referral_earnings, AS_OF_ORDERS, 12)


@register("daily_revenue", f"""
WITH c AS (SELECT payment_id, SUM(amount) AS c_sum FROM commissions GROUP BY payment_id)
SELECT date_trunc('day', p.created_at) AS date,
       COUNT(DISTINCT p.id) AS transactions,
       {money("COALESCE(SUM(p.amount), 0)")} AS revenue,
       {money("COALESCE(SUM(c.c_sum), 0)")} AS commissions,
       {money("COALESCE(SUM(p.amount - COALESCE(c.c_sum, 0)), 0)")} AS net_revenue
FROM payments p LEFT JOIN c ON p.id = c.payment_id
WHERE p.created_at BETWEEN TIMESTAMP '{RANGE_START}' AND TIMESTAMP '{RANGE_END}'
GROUP BY 1
""", headline=True)
def q_daily_revenue(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return finance.daily_revenue(t.payments, t.commissions, RANGE_START, RANGE_END)


@register("daily_revenue_as_written", f"""
WITH per AS (SELECT payment_id, COUNT(*) AS k, SUM(amount) AS paid FROM commissions GROUP BY ALL),
days AS (SELECT date_trunc('day', created_at) AS date, amount * COALESCE(k, 1) AS gross, COALESCE(paid, 0) AS paid
         FROM payments LEFT JOIN per ON payment_id = id
         WHERE created_at BETWEEN TIMESTAMP '{RANGE_START}' AND TIMESTAMP '{RANGE_END}')
SELECT date, COUNT(*) AS transactions, {money("SUM(gross)")} AS revenue, {money("SUM(paid)")} AS commissions,
       {money("SUM(gross) - SUM(paid)")} AS net_revenue
FROM days GROUP BY date
""")
def q_daily_revenue_as_written(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return finance.daily_revenue(t.payments, t.commissions, RANGE_START, RANGE_END,
                                 fanout="as_written")


@register("commissions_report", f"""
WITH dated AS (SELECT referral_id, SUM(amount) AS total FROM commissions
               WHERE created_at BETWEEN TIMESTAMP '{RANGE_START}' AND TIMESTAMP '{RANGE_END}' GROUP BY ALL),
sold AS (SELECT referrer_id, total,
                referred_business_id IN (SELECT id FROM businesses WHERE subscription_status = 'active') AS live
         FROM referrals JOIN dated ON referral_id = referrals.id)
SELECT id AS salesperson_id, business_name AS salesperson, COUNT(*) AS total_referrals,
       COUNT(*) FILTER (WHERE live) AS active_referrals, {money("SUM(total)")} AS total_commission
FROM businesses JOIN sold ON referrer_id = id
WHERE is_salesperson GROUP BY id, business_name
""", headline=True)
def q_commissions_report(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return finance.commissions_report(t.businesses, t.referrals, t.commissions,
                                      RANGE_START, RANGE_END)
