"""Time the registered queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores; ``BENCH_QUERIES`` may
name a comma-separated subset and ``BENCH_RUNS`` the timed runs per query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from claimweave.plans import QUERIES  # noqa: E402
from claimweave.session import get_session  # noqa: E402

HEADLINE = (
    "omitted_charge_findings",
    "tier_classification",
    "group_and_price",
    "whatif_impact",
    "rule_findings",
    "claim_collections",
    "conflicting_upserts",
    "evidence_grounding",
    "relation_domain_range",
    "duplicate_consolidation",
    "review_budget",
    "plan_metrics",
    "terminal_decisions",
    "packet_hashes",
    "chain_verify",
    "opportunity_synthesis",
    "evaluation_metrics",
    "profile_columns",
    "dataset_fingerprint",
    "mapping_claims",
    "outbox_enqueue",
    "denied_amounts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    spark = get_session(
        "claimweave-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cores": int(cpus),
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
