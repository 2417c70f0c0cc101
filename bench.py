"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: prints one JSON line.

Each query is run once to warm up and then ``$BENCH_RUNS`` times; the median counts. All rows are
computed and discarded by the ``noop`` sink. Command-line names choose other queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from deskweave.operators.staging import release_staged  # noqa: E402
from deskweave.queries import QUERIES  # noqa: E402
from deskweave.session import local_session  # noqa: E402

HEADLINE = (
    "eval_field_performance", "eval_scenario", "eval_branch_pivot", "holdout_sample", "token_df", "bm25_topk", "evidence_budget",
    "html_text", "recent_history", "exact_distinct", "key_repair", "redact_email", "finding_decision", "finding_dedup",
    "portfolio_breakdown", "audit_report", "rule_gap", "provision_decision", "access_decision", "recurring_incidents",
    "request_lifecycle", "critical_path", "box_rollup", "duration_quantiles", "eta_backtest", "rolling_duration", "latest_state",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "16g")
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
            release_staged(spark)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "runs": runs, "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
