"""Time the headline queries on whole tables and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import time

from stayline.plans import registry
from stayline.session import local_session

HEADLINE = (
    "account_features",
    "quality_log",
    "portfolio_position",
    "segment_performance",
    "attachment_effect",
    "kaplan_meier",
    "survival_by_contract",
    "logrank_test",
    "stratified_split",
    "scored_accounts",
    "decile_table",
    "auc",
    "programme_options",
    "breakeven_sensitivity",
    "fixed_loss_share",
    "fct_customer_risk",
    "driver_odds_ratios",
    "metrics_document",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, partitions=int(cpus), app="stayline-bench")
    queries = registry.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # Untimed, so that no query pays for loading the engine.
    for name in ("segment_performance", "scored_accounts"):
        run(name)
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
