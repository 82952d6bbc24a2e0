"""Bank details: payout view (R31), field rules (D6), upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import BANK_RULES
from ..functions.scalar import as_of_lit, full_match
from .common import P, upsert

BANK_FIELDS = ["account_holder_name", "transit_number", "institution_number",
               "account_number", "bank_name", "account_type"]


def bank_details_view(bank_details: DataFrame) -> DataFrame:
    """Bank details under the payout names."""
    return bank_details.select(
        "business_id",
        F.col("account_holder_name").alias("accountHolderName"),
        F.col("transit_number").alias("transitNumber"),
        F.col("institution_number").alias("institutionNumber"),
        F.col("account_number").alias("accountNumber"),
        F.col("bank_name").alias("bankName"),
        F.col("account_type").alias("accountType"))


def validate_bank_details(changes: DataFrame) -> DataFrame:
    """The first failing field names the error; whole-string digit
    patterns, so a trailing newline fails (``\\z``, not ``$``)."""
    err = F.lit(None).cast("string")
    for col, pattern, message in reversed(BANK_RULES):
        err = F.when(~full_match(F.col(col), pattern), F.lit(message)).otherwise(err)
    return changes.withColumn("error", err).withColumn("valid", F.col("error").isNull())


def upsert_bank_details(bank_details: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """Valid changes (D6) replace every field of the business's row, or
    insert one; the last change per business wins."""
    ok = validate_bank_details(changes).where("valid").select(
        "business_id", *BANK_FIELDS, "changed_at")
    sets = {c: P(c) for c in BANK_FIELDS}
    sets["updated_at"] = as_of_lit(as_of)
    ins = dict(sets)
    return upsert(bank_details, ok, ["business_id"], sets=sets, inserts=ins, order_col="changed_at")
