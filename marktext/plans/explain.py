"""Print the formatted physical plan of registered queries.

    python -m marktext.plans.explain [--sf DIR] [--only a,b] [--summary]

``--summary`` prints one line per query: scans with their ReadSchema / PushedFilters,
and the count of exchanges, broadcasts, windows and Python evaluations.
"""

from __future__ import annotations

import argparse
import re
import sys


def summarize(plan: str) -> dict:
    return {
        "read_schema": sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*>)", plan))),
        "pushed_filters": sorted(set(re.findall(r"PushedFilters: (\[[^\]]*\])", plan))),
        "exchanges": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "python": len(re.findall(r"ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas", plan)),
        "cartesian": plan.count("CartesianProduct") + plan.count("BroadcastNestedLoopJoin"),
    }


def main(argv=None) -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--summary", action="store_true")
    args = ap.parse_args(argv)
    from ..session import get_spark
    spark = get_spark("local[8]", 8)
    from .queries import QUERIES
    names = [n for n in (args.only.split(",") if args.only else QUERIES) if n in QUERIES]
    for name in names:
        df = QUERIES[name](spark, args.sf)
        if args.summary:
            plan = df._jdf.queryExecution().executedPlan().toString()
            print(name, summarize(plan), flush=True)
        else:
            print(f"===== {name}", flush=True)
            df.explain("formatted")
    return 0


if __name__ == "__main__":
    sys.exit(main())
