"""Run every registered query against its DuckDB oracle and print one line each.

usage: python check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import sys
import time

from ledgerlark.plans.check import compare, duck_connect
from ledgerlark.plans.registry import all_queries
from ledgerlark.session import build_session


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = build_session("local[8]", 8)
    con = duck_connect(sf_dir)
    bad = 0
    for name, spec in all_queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = spec.build(spark, sf_dir)
            if spec.oracle is None:
                res = {"rows": df.count(), "oracle": None}
            else:
                res = compare(df, spec.oracle, con)
                bad += 0 if res["match"] else 1
        except Exception as e:  # report and go on
            res = {"error": f"{type(e).__name__}: {str(e)[:400]}"}
            bad += 1
        res["sec"] = round(time.time() - t0, 2)
        print(name, json.dumps(res, default=str), flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
