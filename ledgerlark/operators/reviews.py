"""Reviews: stats (R1), latest n (R2), listings (R3, R4) and the review
change jobs: replies (M6), survey answers (M7), ingest (M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import DEFAULT_REVIEW_SOURCE, POSITIVE_RATING, RECENT_REVIEWS
from ..functions.scalar import as_of_lit, ratio_round1
from .common import apply_patch, top_n_by_key

REVIEW_OUT = ["id", "business_id", "customer_name", "rating", "comment", "reply",
              "replied_at", "source", "created_at", "improvement_areas", "feedback"]


def review_stats(reviews: DataFrame, businesses: DataFrame | None = None) -> DataFrame:
    """Per business: total, positive (rating >= 4), negative (< 4), and the
    average rating to one decimal (half up, exact).  With ``businesses`` every
    business appears, with 0, 0, 0, NULL when it has no review."""
    agg = reviews.groupBy("business_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("rating") >= POSITIVE_RATING, 1)).alias("positive"),
        F.count(F.when(F.col("rating") < POSITIVE_RATING, 1)).alias("negative"),
        F.sum("rating").alias("_rsum"), F.count("rating").alias("_rn"))
    if businesses is not None:
        agg = businesses.select(F.col("id").alias("business_id")).join(agg, "business_id", "left")
    zero = F.lit(0).cast("long")
    return agg.select(
        "business_id",
        F.coalesce("total", zero).alias("total"),
        F.coalesce("positive", zero).alias("positive"),
        F.coalesce("negative", zero).alias("negative"),
        ratio_round1(F.col("_rsum"), F.col("_rn")).alias("average_rating"))


def recent_reviews(reviews: DataFrame, n: int = RECENT_REVIEWS) -> DataFrame:
    """R2: the ``n`` newest reviews per business (created_at DESC NULLS FIRST,
    id DESC to break ties)."""
    order = [F.col("created_at").desc_nulls_first(), F.col("id").desc()]
    return top_n_by_key(reviews, "business_id", order, n).select(
        "business_id", "id", "rating", "comment", "created_at", "customer_name")


def business_reviews(reviews: DataFrame) -> DataFrame:
    """All reviews with survey fields, newest first within each business."""
    return reviews.select("id", "business_id", "customer_name", "rating", "comment",
                          "created_at", "improvement_areas", "feedback", "source").orderBy(
        "business_id", F.col("created_at").desc_nulls_first(), F.col("id").desc())


def reviews_by_sentiment(reviews: DataFrame, flt: str | None) -> DataFrame:
    """Positive (>= 4), negative (< 4), or every review for any other filter."""
    if flt == "positive":
        reviews = reviews.where(F.col("rating") >= POSITIVE_RATING)
    elif flt == "negative":
        reviews = reviews.where(F.col("rating") < POSITIVE_RATING)
    return reviews.select(*REVIEW_OUT).orderBy(
        "business_id", F.col("created_at").desc_nulls_first(), F.col("id").desc())


def apply_replies(reviews: DataFrame, replies: DataFrame, as_of) -> DataFrame:
    """M6: set reply and replied_at (= ``as_of``) where both the review id and
    the business match; the last reply per review wins."""
    p = replies.select(F.col("review_id").alias("id"), "business_id", "reply", "requested_at")
    return apply_patch(reviews, p, ["id", "business_id"],
                       {"reply": "reply", "replied_at": as_of_lit(as_of)},
                       order_col="requested_at", patch_cols=["reply", "requested_at"],
                       flag="changed")


def apply_surveys(reviews: DataFrame, surveys: DataFrame) -> DataFrame:
    """M7: survey answers (comma list of areas, feedback) onto a review, same
    two-column match as M6; the last submitted survey per review wins."""
    p = surveys.select(F.col("review_id").alias("id"), "business_id",
                       F.split(F.col("areas"), ",").alias("areas"), "feedback", "submitted_at")
    return apply_patch(reviews, p, ["id", "business_id"],
                       {"improvement_areas": "areas", "feedback": "feedback"},
                       order_col="submitted_at", patch_cols=["areas", "feedback", "submitted_at"],
                       flag="changed")


def ingest_reviews(reviews: DataFrame, new: DataFrame, businesses: DataFrame):
    """M8: append new reviews (source defaults to 'direct') and return
    ``(new_table, receipts)``; a receipt is the review id with the business's
    Google review link (NULL for an unknown business)."""
    rows = new.select(
        *[F.col(c) if c in new.columns else F.lit(None).cast(reviews.schema[c].dataType).alias(c)
          for c in reviews.columns if c != "source"],
        F.coalesce(F.col("source"), F.lit(DEFAULT_REVIEW_SOURCE)).alias("source")).select(*reviews.columns)
    receipts = rows.select(F.col("id").alias("review_id"), "business_id", "source").join(
        businesses.select(F.col("id").alias("business_id"), "google_review_link"),
        "business_id", "left")
    return reviews.unionByName(rows), receipts
