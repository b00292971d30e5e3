"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
number of local threads. Every query is computed in full into a sink that drops
the rows; it runs twice and the second run counts, so that code generation and
class loading are not what is measured.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tenure.plans import registry  # noqa: E402
from tenure.session import prepare, session  # noqa: E402

HEADLINE = (
    "top2_next_claimable",
    "top3_next_claimable_per",
    "asg1_assign_batch",
    "val1_audit_steps",
    "val4_audit_transitions",
    "val5_validate_tasks",
    "rec1_drain_expired",
    "rec3_sweep",
    "fen1_authorize",
    "fen4_apply_renewals",
    "fen5_apply_completions",
    "fen6_apply_failures",
    "lea1_lease_spans",
    "fen2_authorize_asof",
    "stm2_fold_state",
    "ide1_apply_effects",
    "ide4_effect_consistency",
    "ide6_fingerprint",
    "evt2_page",
    "evt5_missed_by_id_cursor",
    "evt6_history",
    "evt8_reconcile_state",
    "own1_duplicate_grants",
    "own2_grants_vs_events",
    "own3_generation_gaps",
    "met1_per_step",
    "met2_run_summary",
    "met3_latency_percentiles",
    "stm5_ordered_release",
    "stm6_event_rate",
    "fen3_stale_summary",
    "evt7_conformance",
    "evt7_lifecycle_conformance",
    "met4_spread",
    "stm1_lifecycle_events",
    "stm3_dedupe_effects",
    "stm4_heartbeat_alerts",
    "stm7_sweep_stream",
    "evt7_pattern",
    "evt7_pattern_of_long_histories",
    "asg1_assign_all",
    "ide6_differences",
    "snk1_committed_history",
    "src2_tail_events",
    "stm2_given_state",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        f"local[{cpus}]",
        int(cpus) if cpus.isdigit() else 8,
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    prepare(spark).sparkContext.setLogLevel("ERROR")
    registry.load_all()
    wanted = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in wanted:
        for _run in range(2):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
