"""Review reports R1-R4 and review change jobs M6-M8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reviews as rv
from ..sources import load_tables
from .params import AS_OF_EVENTS
from .registry import register


@register("review_stats", """
SELECT b.id AS business_id,
       COUNT(r.business_id) AS total,
       COUNT(CASE WHEN r.rating >= 4 THEN 1 END) AS positive,
       COUNT(CASE WHEN r.rating < 4 THEN 1 END) AS negative,
       CAST(ROUND(CAST(SUM(r.rating) * 1000000 // COUNT(r.rating) AS DECIMAL(18,0))
                  * CAST(0.000001 AS DECIMAL(7,6)), 1) AS DOUBLE) AS average_rating
FROM businesses b LEFT JOIN reviews r ON r.business_id = b.id
GROUP BY b.id
""", headline=True)
def q_review_stats(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return rv.review_stats(t.reviews, t.businesses)


@register("recent_reviews", """
SELECT business_id, id, rating, comment, created_at, customer_name FROM reviews
QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY created_at DESC NULLS FIRST, id DESC) <= 5
""", headline=True)
def q_recent_reviews(spark, sf_dir):
    return rv.recent_reviews(load_tables(spark, sf_dir).reviews, 5)


@register("business_reviews", """
SELECT id, business_id, customer_name, rating, comment, created_at, improvement_areas, feedback, source
FROM reviews
""")
def q_business_reviews(spark, sf_dir):
    return rv.business_reviews(load_tables(spark, sf_dir).reviews)


@register("reviews_by_sentiment", """
SELECT id, business_id, customer_name, rating, comment, reply, replied_at, source, created_at,
       improvement_areas, feedback
FROM reviews WHERE rating < 4
""")
def q_reviews_by_sentiment(spark, sf_dir):
    return rv.reviews_by_sentiment(load_tables(spark, sf_dir).reviews, "negative")


@register("apply_replies", f"""
WITH rp AS (
  SELECT review_id, business_id, reply FROM review_replies
  QUALIFY row_number() OVER (PARTITION BY review_id, business_id ORDER BY requested_at DESC) = 1)
SELECT r.id, r.business_id,
       CASE WHEN rp.review_id IS NULL THEN r.reply ELSE rp.reply END AS reply,
       CASE WHEN rp.review_id IS NULL THEN r.replied_at ELSE TIMESTAMP '{AS_OF_EVENTS}' END AS replied_at,
       rp.review_id IS NOT NULL AS changed
FROM reviews r LEFT JOIN rp ON rp.review_id = r.id AND rp.business_id = r.business_id
""")
def q_apply_replies(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return rv.apply_replies(t.reviews, t.review_replies, AS_OF_EVENTS).select(
        "id", "business_id", "reply", "replied_at", "changed")


@register("apply_surveys", """
SELECT r.id, r.business_id,
       CASE WHEN s.review_id IS NULL THEN array_to_string(r.improvement_areas, ',')
            ELSE array_to_string(string_split(s.areas, ','), ',') END AS areas_text,
       CASE WHEN s.review_id IS NULL THEN r.feedback ELSE s.feedback END AS feedback,
       s.review_id IS NOT NULL AS changed
FROM reviews r LEFT JOIN (
  SELECT * FROM review_surveys
  QUALIFY row_number() OVER (PARTITION BY review_id, business_id ORDER BY submitted_at DESC) = 1) s
  ON s.review_id = r.id AND s.business_id = r.business_id
""")
def q_apply_surveys(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    return rv.apply_surveys(t.reviews, t.review_surveys).select(
        "id", "business_id", F.array_join("improvement_areas", ",").alias("areas_text"),
        "feedback", "changed")


@register("ingest_reviews", """
SELECT n.id AS review_id, n.business_id, COALESCE(n.source, 'direct') AS source, b.google_review_link
FROM new_reviews n LEFT JOIN businesses b ON b.id = n.business_id
""")
def q_ingest_reviews(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    _, receipts = rv.ingest_reviews(t.reviews, t.new_reviews, t.businesses)
    return receipts
