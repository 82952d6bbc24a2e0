"""QR codes: listing with review URL (R28), scan resolution (R29), upsert (M9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import QR_ID_LENGTH, REVIEW_PATH
from ..functions.scalar import as_of_lit, keyed_id
from .common import P, T, above_max, earliest_by_key, upsert


def review_url(base_url: str, url_id) -> F.Column:
    """``{base}/review/{url_id}``; NULL when the id is missing."""
    return F.concat(F.lit(base_url), F.lit(REVIEW_PATH), url_id)


def qr_codes_view(qr_codes: DataFrame, businesses: DataFrame, base_url: str) -> DataFrame:
    """QR codes with the business name and the review URL."""
    b = businesses.select(F.col("id").alias("business_id"), "business_name")
    return qr_codes.join(b, "business_id").select(
        "id", "business_id", "type", "url_id", "scans", "created_at", "updated_at",
        "business_name", review_url(base_url, F.col("url_id")).alias("review_url"))


def _by_url(qr_codes: DataFrame) -> DataFrame:
    return earliest_by_key(qr_codes.where(F.col("url_id").isNotNull()), ["url_id"], ["id"],
                           ["url_id", "business_id"])


def resolve_scans(scans: DataFrame, qr_codes: DataFrame, businesses: DataFrame):
    """Scanned url ids to businesses.  Returns ``(hits, misses)``; misses
    are the ids no QR code (or no business) answers, the reference's 404."""
    b = businesses.select(F.col("id").alias("business_id"), "business_name", "google_review_link")
    target = _by_url(qr_codes).join(b, "business_id")
    hits = scans.join(target, "url_id").select("scan_id", "url_id", "business_id",
                                               "business_name", "google_review_link")
    misses = scans.join(target, "url_id", "left_anti").select("scan_id", "url_id")
    return hits, misses


def upsert_qr_codes(qr_codes: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """M9: upsert on (business_id, type).  An existing url id is kept; a row
    without one (or a new row) takes the change's proposed id, else a
    deterministic one from the key (F16).  ``scans`` is carried through; new
    rows start at 0 and take an id above all stored ones.  The last change per key wins."""
    gen = F.coalesce(P("url_id"), keyed_id(P("business_id"), P("type"), length=QR_ID_LENGTH))
    now = as_of_lit(as_of)
    ch = changes.select("business_id", "type", "url_id", "change_id", "updated_at")
    return upsert(
        qr_codes, ch, ["business_id", "type"],
        sets={"url_id": F.coalesce(T("url_id"), gen), "updated_at": now},
        inserts={"id": above_max(qr_codes, P("change_id")), "url_id": gen, "scans": F.lit(0),
                 "created_at": now, "updated_at": now},
        order_col=["updated_at", "change_id"])
