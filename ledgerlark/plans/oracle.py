"""Oracle SQL: the adapters as CTEs in front of a hand-written query body.

The body is independent SQL (written from the reference's statements,
generalised to all tenants); only the input-building CTEs are shared with the
Spark side.
"""

from __future__ import annotations

import re

from ..sources.adapters import ADAPTERS, adapter_sql


def with_adapters(body: str) -> str:
    """Prefix ``body`` with a CTE for every domain table it names."""
    names = [t for t in ADAPTERS if re.search(rf"\b{t}\b", body)]
    if not names:
        return body
    ctes = ",\n".join(f"{t} AS ({adapter_sql(t)})" for t in names)
    body = body.strip()
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE)
    if m:
        rec = "RECURSIVE " if m.group(1) else ""
        return f"WITH {rec}{ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"
