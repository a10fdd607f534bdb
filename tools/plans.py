"""Write PLANS.md: the physical-plan outline (operators only) of the headline queries.

Usage: python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelrisk.plans.queries import QUERIES  # noqa: E402
from panelrisk.session import local_session  # noqa: E402

SHOW = ["lag_diff", "panel_features", "stratified_split", "roc_auc", "drift_numeric", "sparse_rows",
        "group_median_impute", "recent_predictions", "validate_input"]
KEEP = ("Scan", "Exchange", "Join", "Window", "Aggregate", "TakeOrdered", "Subquery", "Generate", "Filter")


def outline(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    out = []
    for line in plan:
        if any(k in line for k in KEEP):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r", \[plan_id=\d+\]", "", line)
            line = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\], ", "", line)
            out.append(line[:200])
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, 16)
    parts = ["# Physical plans of the headline queries", "",
             f"Operator outline of `executedPlan` (before AQE re-optimisation) at `{os.path.basename(sf)}`, "
             "generated by `tools/plans.py`. Stage tables written earlier by a query (reshaped panel, "
             "count tables) appear as Parquet scans of the checkpoint folder.", ""]
    for name in SHOW:
        parts += [f"## {name}", "", "```", *outline(QUERIES[name](spark, sf)), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(parts))


if __name__ == "__main__":
    main()
