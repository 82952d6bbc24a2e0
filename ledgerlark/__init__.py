"""ledgerlark: review-business analytics as Spark DataFrame jobs.

Reports, row rules, batch change jobs and a billing event fold over the
domain tables declared in ``ledgerlark.sources.schemas``.  Every operator
takes and returns DataFrames and works on all tenants at once.
"""

from .session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
