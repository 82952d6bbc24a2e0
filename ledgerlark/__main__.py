"""Run a registered query and write its full result.

usage: python -m ledgerlark QUERY --sf-dir DIR --out PATH [--format parquet|json|csv]
       python -m ledgerlark --list
"""

from __future__ import annotations

import argparse
import sys

from .plans.registry import all_queries
from .session import build_session, checkpoint_dir


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="ledgerlark")
    ap.add_argument("query", nargs="?")
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--out")
    ap.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    ap.add_argument("--master", default=None, help="e.g. local[8]; omit under spark-submit")
    ap.add_argument("--list", action="store_true")
    a = ap.parse_args(argv)
    specs = all_queries()
    if a.list or not a.query:
        print("\n".join(sorted(specs)))
        return 0
    if a.query not in specs or not a.out:
        ap.error("unknown query or missing --out")
    spark = build_session(a.master)
    checkpoint_dir(spark)
    df = specs[a.query].build(spark, a.sf_dir)
    w = df.write.mode("overwrite")
    if a.format == "csv":
        w = w.option("header", "true")
    getattr(w, a.format)(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
