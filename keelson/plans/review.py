"""Physical-plan review: for each query, count shuffles, join strategies,
windows and Python stages, and list what each Parquet scan reads.

    python -m keelson.plans.review /root/testdata/sf0.01 > PLANS.md
"""

from __future__ import annotations

import re
import sys


def summarize(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet [^\n]*?Location: [^\[]*\[[^\]]*?/([a-z]+)\.parquet\][^\n]*?ReadSchema: (struct<[^>]*>)", plan)
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
    return {
        "exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "group_limits": plan.count("WindowGroupLimit"),
        "python": len(re.findall(r"(MapInPandas|ArrowEvalPython|FlatMapGroupsInPandas|BatchEvalPython)", plan)),
        "scans": sorted(set(scans)),
        "pushed": sorted({p for p in pushed if p}),
    }


def main(sf_dir: str, keys: list[str] | None = None) -> None:
    from keelson.plans.catalog import QUERIES
    from keelson.session import get_spark
    spark = get_spark("local[4]", app="keelson-plan-review", shuffle_partitions=8,
                      extra={"spark.sql.adaptive.enabled": "false"})
    print("# Physical plans (static, AQE off so joins show their planned strategy)\n")
    print(f"Data: `{sf_dir}`. Columns: shuffles (Exchange), broadcast / sort-merge joins, windows, "
          "partial group limits, Python stages; then each scan's table and ReadSchema.\n")
    print("| query | shuffles | BHJ | SMJ | windows | group limits | python |\n| --- | --- | --- | --- | --- | --- | --- |")
    details = []
    for k in keys or sorted(QUERIES):
        try:
            s = summarize(QUERIES[k](spark, sf_dir))
        except Exception as exc:  # keep going; report the failure
            print(f"| {k} | error: {str(exc)[:60]} | | | | | |")
            continue
        print(f"| {k} | {s['exchanges']} | {s['bhj']} | {s['smj']} | {s['windows']} | {s['group_limits']} | {s['python']} |")
        details.append((k, s))
    print("\n## Scans (table: columns read)\n")
    for k, s in details:
        scans = "; ".join(f"{t}: {r[7:-1]}" for t, r in s["scans"])
        print(f"- **{k}** — {scans}" + (f" — pushed: {', '.join(s['pushed'])}" if s["pushed"] else ""))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2].split(",") if len(sys.argv) > 2 else None)
