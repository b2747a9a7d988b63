"""Write docs/PLANS.md: the physical plan trees of the headline queries.

    python tools/explain_plans.py [/root/testdata/sf0.1]
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

HEADLINE = ["national_totals", "la_registered_totals", "la_sites_totals", "itl2_sites_totals",
            "la_code_totals", "map_la_sites", "share_of_total"]


def tree(df) -> str:
    """The operator tree of ``explain('formatted')`` (the part before the node details)."""
    plan = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    head = plan.split("\n\n\n")[0]
    return re.sub(r"#\d+", "", head)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from areastats.plans.registry import QUERIES
    from areastats.session import local_session
    from areastats.sources.fixtures import fixtures

    spark = local_session()
    fixtures(spark, sf_dir).prepare()
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/explain_plans.py` on `{sf_dir}` (local[8], AQE on). These are the",
           "plans before execution; AQE may still coalesce partitions or switch a join at run time. No",
           "join carries a hint: the planner broadcasts what its size estimate in bytes allows.",
           ""]
    for name in HEADLINE:
        df = QUERIES[name](spark, sf_dir)
        out += [f"## {name}", "", "```", tree(df), "```", ""]
    with open(os.path.join(ROOT, "docs", "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
