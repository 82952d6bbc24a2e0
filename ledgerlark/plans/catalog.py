"""Imports every catalog module so that all queries register."""

from . import q_accounts, q_billing, q_commerce, q_finance, q_referrals, q_reviews  # noqa: F401
