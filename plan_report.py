"""Plan review: run every registered query and summarise its final physical
plan (after AQE) into PLANS.md.

usage: python plan_report.py [sf_dir] [out.md]
"""

from __future__ import annotations

import re
import sys
from collections import Counter

from ledgerlark.plans.registry import all_queries
from ledgerlark.session import build_session, checkpoint_dir

PATTERNS = {
    "shuffle": r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)",
    "broadcast": r"BroadcastExchange",
    "smj": r"SortMergeJoin",
    "bhj": r"BroadcastHashJoin",
    "shj": r"ShuffledHashJoin",
    "nested_loop": r"BroadcastNestedLoopJoin|CartesianProduct",
    "hash_agg": r"HashAggregate",
    "sort_agg": r"SortAggregate",
    "window": r"\bWindow\b",
    "group_limit": r"WindowGroupLimit",
    "python": r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas",
}


def final_plan(df) -> str:
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString()


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    out = argv[1] if len(argv) > 1 else "PLANS.md"
    spark = build_session("local[8]", 8, app="ledgerlark-plans")
    checkpoint_dir(spark)
    rows = []
    for name, spec in sorted(all_queries().items()):
        df = spec.build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        p = final_plan(df)
        c = {k: len(re.findall(v, p)) for k, v in PATTERNS.items()}
        scans = re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\]", p)
        widest = max((len(s.split(",")) for s in scans), default=0)
        rows.append((name, c, len(scans), widest))
    head = ("| query | shuffles | broadcasts | SMJ | BHJ | SHJ | nested loop | hash agg | sort agg "
            "| window | group limit | python | scans | widest scan (cols) |")
    lines = ["# Physical plans", "",
             f"Final plans after AQE for every registered query at `{sf_dir}` on local[8] "
             "(`python plan_report.py`). Counts are operators in the executed plan.", "",
             head, "|" + "---|" * 14]
    for name, c, n_scans, widest in rows:
        lines.append(f"| {name} | {c['shuffle']} | {c['broadcast']} | {c['smj']} | {c['bhj']} | "
                     f"{c['shj']} | {c['nested_loop']} | {c['hash_agg']} | {c['sort_agg']} | "
                     f"{c['window']} | {c['group_limit']} | {c['python']} | {n_scans} | {widest} |")
    tot = Counter()
    for _, c, _, _ in rows:
        tot.update(c)
    lines += ["", f"Totals: {dict(tot)}", ""]
    with open(out, "w") as f:
        f.write("\n".join(lines) + "\n")
    print(f"wrote {out}: {len(rows)} queries, nested loops {tot['nested_loop']}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
