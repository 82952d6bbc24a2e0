"""Subscriptions: the current row per business and the rules that read it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.schemas import COLUMNS
from .common import Desc, latest_by_key

SUB_COLS = [c for c, _ in COLUMNS["subscriptions"]]


def current_subscriptions(subscriptions: DataFrame, *cols: str) -> DataFrame:
    """One subscription per business (X16): the highest id, i.e. the latest
    insert, since nothing in the source keeps the table unique per business.  Only
    business_id and ``cols`` (default: all) are read and shuffled."""
    cols = ["business_id", *cols] if cols else [c for c in SUB_COLS if c in subscriptions.columns]
    return latest_by_key(subscriptions.where("business_id IS NOT NULL"), ["business_id"],
                         [Desc("id", nulls_first=False)], cols)
