"""List plan nodes that would not scale, for every registered query."""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from claimweave.plans import QUERIES  # noqa: E402
from claimweave.session import get_session  # noqa: E402

SUSPECTS = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "SinglePartition")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or QUERIES:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        found = {node: len(re.findall(node, plan)) for node in SUSPECTS if node in plan}
        print(f"{name:28s} exchanges={len(re.findall(r'Exchange hashpartitioning', plan)):3d} {found or ''}", flush=True)


if __name__ == "__main__":
    main()
