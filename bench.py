"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores. Derived tables (the
change log and its decoded form) are written first and timed on their own as
``write_log`` and ``write_changelog``; the decoding queries read the stored log.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "decode_changelog",
    "current_state",
    "current_as_of",
    "reconcile_current",
    "row_diff_corrupted",
    "row_diff_by_key",
    "snapshot_digest",
    "ordered_snapshot_digest",
    "duplicate_event_ids",
    "redelivery_audit",
    "event_id_audit",
    "miskey_audit",
    "admission_gate",
    "dlq_repair",
    "wire_header_audit",
    "group_lag",
    "rebuild_from_zero",
    "rebuild_from_timestamp",
    "linkage",
    "freshness",
    "freshness_buckets",
    "throughput",
    "metric_samples",
    "backpressure",
    "zero_lag_runs",
    "user_state_transitions",
    "numeric_paths",
    "schema_evolution",
    "compaction_plan",
    "file_stats",
    "key_constraints",
    "generated_orders",
    "ledger_validation",
    "stream_exactly_once",
    "stream_compacted",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tidemark import build_session
    from tidemark.plans import fixtures
    from tidemark.plans.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        conf={
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    fixtures.table(spark, sf_dir, "orders").count()  # starts the executors

    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    timed("write_log", lambda: fixtures.log_table(spark, sf_dir))
    timed("write_changelog", lambda: fixtures.changelog_table(spark, sf_dir))
    timed("write_probe", lambda: fixtures.probe_table(spark, sf_dir))
    records = fixtures.log_table(spark, sf_dir).count()
    for name in HEADLINE:
        timed(
            name,
            lambda name=name: QUERIES[name](spark, sf_dir)
            .write.format("noop")
            .mode("overwrite")
            .save(),
        )
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "log_records": records,
                "decode_records_per_second": round(records / seconds["decode_changelog"]),
                "stream_records_per_second": round(records / seconds["stream_exactly_once"]),
            }
        )
    )


if __name__ == "__main__":
    main()
