"""Structured Streaming: the billing event fold."""
