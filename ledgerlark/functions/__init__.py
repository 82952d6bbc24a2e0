"""Scalar Column helpers (F1-F22): all built-in Spark expressions, no UDFs."""

from .scalar import *  # noqa: F401,F403
