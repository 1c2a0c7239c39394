"""Freshness, throughput, lag and load measurements."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import blocked
from tidemark.functions.columns import clamp, floor_div, metric_key
from tidemark.functions.ranks import percentile_nearest_rank

# ---------------------------------------------------------------- fixed values
RECOVERED_AFTER = 3  # zero-lag samples in a row
# Regression budgets: measurement -> (limit, direction)
BUDGETS = {
    "end_to_end_rows_per_second": (1790.0, "at_least"),
    "end_to_end_seconds": (56.0, "at_most"),
    "freshness_p50_ms": (15_300.0, "at_most"),
    "freshness_p95_ms": (20_700.0, "at_most"),
    "recovery_broker_restart_seconds": (48.0, "at_most"),
    "recovery_duplicate_redelivery_seconds": (51.0, "at_most"),
    "recovery_mis_keying_seconds": (25.0, "at_most"),
    "recovery_poison_dlq_seconds": (53.0, "at_most"),
    "recovery_offset_replay_seconds": (39.0, "at_most"),
}
# ------------------------------------------------------------------------------


# -- progress and lag -----------------------------------------------------------


def progress(table: DataFrame, name: str) -> DataFrame:
    return table.agg(
        F.lit(name).alias("side"),
        F.coalesce(F.max("event_id"), F.lit(0)).alias("max_event_id"),
        F.count(F.lit(1)).alias("rows"),
    )


def commit_lag(source: DataFrame, changelog: DataFrame) -> DataFrame:
    """Id gap and row lag of the changelog behind the source, not below zero."""
    both = progress(source, "source").unionByName(progress(changelog, "changelog"))

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    return both.agg(
        of("source", "max_event_id").alias("source_max_event_id"),
        of("changelog", "max_event_id").alias("changelog_max_event_id"),
        of("source", "rows").alias("source_rows"),
        of("changelog", "rows").alias("changelog_rows"),
    ).withColumns(
        {
            "max_event_id_gap": F.greatest(
                F.col("source_max_event_id") - F.col("changelog_max_event_id"), F.lit(0)
            ),
            "lag_events": F.greatest(F.col("source_rows") - F.col("changelog_rows"), F.lit(0)),
        }
    )


# -- freshness ------------------------------------------------------------------


def events_in_batches(events: DataFrame, batches: DataFrame, event_id: str, width: int = 4096) -> DataFrame:
    """Range join: each event with the batch whose [first_event_id, last_event_id] holds it.

    Intervals are cut at multiples of ``width``, so the join is an equi join on
    the cut with the range test on top.
    """
    cut = F.explode(
        F.sequence(floor_div(F.col("first_event_id"), width), floor_div(F.col("last_event_id"), width))
    )
    return (
        events.withColumn("__cut", floor_div(F.col(event_id), width))
        .join(batches.withColumn("__cut", cut), "__cut", "inner")
        .where(F.col(event_id).between(F.col("first_event_id"), F.col("last_event_id")))
        .drop("__cut")
    )


def first_visible(visible: DataFrame) -> DataFrame:
    """Earliest snapshot of every event; ``visible`` has (snapshot_id, event_id)."""
    return visible.groupBy("event_id").agg(F.min("snapshot_id").alias("snapshot_id"))


def freshness_samples(visible: DataFrame, snapshots: DataFrame, batches: DataFrame) -> DataFrame:
    """Commit acknowledgement to first visible snapshot, one row per event.

    ``snapshots`` has (snapshot_id, committed_at_epoch_ms) with ids in commit order.
    """
    first = first_visible(visible)
    # one snapshot may show a third of all events
    block = floor_div(F.col("event_id"), 65_536)
    seen = blocked.join_per_key(first, snapshots, ["snapshot_id"], block)
    return events_in_batches(seen, batches, "event_id").select(
        "event_id",
        "snapshot_id",
        "committed_at_epoch_ms",
        (F.col("committed_at_epoch_ms") - F.col("commit_ack_epoch_ms")).alias("latency_ms"),
    )


def freshness_problems(samples: DataFrame, workload: DataFrame) -> DataFrame:
    """Negative latencies and workload events no snapshot shows: both must be 0."""
    ids = samples.select("event_id", F.lit(1).alias("__seen"), (F.col("latency_ms") < 0).alias("__neg"))
    wanted = workload.select("event_id", F.lit(0).alias("__seen"), F.lit(False).alias("__neg"))
    per_event = ids.unionAll(wanted).groupBy("event_id").agg(
        F.max("__seen").alias("seen"), F.max("__neg").alias("neg")
    )
    return per_event.agg(
        F.count_if(F.col("seen") == 0).alias("missing_events"),
        F.count_if(F.col("neg")).alias("negative_latencies"),
    )


def freshness(samples: DataFrame) -> DataFrame:
    """Overall sample count and p50/p95/max by nearest rank."""
    tagged = samples.withColumn("__all", F.lit(0))
    ranks = percentile_nearest_rank(tagged, ["__all"], "latency_ms", {"p50_ms": 50, "p95_ms": 95})
    totals = tagged.groupBy("__all").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
    )
    columns = [c for c in [*totals.columns, *ranks.columns] if c != "__all"]
    both = totals.unionByName(ranks, allowMissingColumns=True)
    return both.groupBy("__all").agg(*[F.max(c).alias(c) for c in columns]).drop("__all")


def freshness_buckets(samples: DataFrame) -> DataFrame:
    """Per snapshot with new events: their count, id range and latency spread."""
    ranks = percentile_nearest_rank(
        samples, ["snapshot_id"], "latency_ms", {"p50_ms": 50, "p95_ms": 95}
    )
    totals = samples.groupBy("snapshot_id").agg(
        F.max("committed_at_epoch_ms").alias("committed_at_epoch_ms"),
        F.count(F.lit(1)).alias("new_event_count"),
        F.min("event_id").alias("first_event_id"),
        F.max("event_id").alias("last_event_id"),
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
    )
    return totals.join(ranks, "snapshot_id")


def throughput(batches: DataFrame, recovered_ms: DataFrame) -> DataFrame:
    """Rows per second to the last acknowledgement and to recovery, spans at least 1 ms.

    ``recovered_ms`` has a column of that name; the latest value counts.
    """
    tagged = batches.select(
        "event_count", "request_started_epoch_ms", "commit_ack_epoch_ms"
    ).unionByName(recovered_ms.select("recovered_ms"), allowMissingColumns=True)
    source = F.greatest((F.col("acked") - F.col("started")) / 1000.0, F.lit(0.001))
    total = F.greatest((F.col("recovered") - F.col("started")) / 1000.0, F.lit(0.001))
    return tagged.agg(
        F.sum("event_count").alias("rows"),
        F.min("request_started_epoch_ms").alias("started"),
        F.max("commit_ack_epoch_ms").alias("acked"),
        F.max("recovered_ms").alias("recovered"),
    ).select(
        "rows",
        F.round(source, 3).alias("source_insert_seconds"),
        F.round(total, 3).alias("end_to_end_seconds"),
        F.round(F.col("rows") / source, 3).alias("source_insert_rows_per_second"),
        F.round(F.col("rows") / total, 3).alias("end_to_end_rows_per_second"),
    )


# -- metrics --------------------------------------------------------------------


def of_job(metrics: DataFrame, job: str | None, labels: Sequence[str]) -> DataFrame:
    """Samples of one job; samples without a job label pass."""
    if job is None:
        return metrics
    value = F.coalesce(*[F.nullif(F.col("labels")[name], F.lit("")) for name in labels])
    return metrics.where(value.isNull() | (value == job))


def _name_ends_with(suffixes: Sequence[str]) -> Column:
    hit = F.lit(False)
    for suffix in suffixes:
        hit = hit | F.endswith(metric_key("name"), metric_key(F.lit(suffix)))
    return hit


def max_metric(
    metrics: DataFrame, suffixes: Sequence[str], keys: Sequence[str] = (), job: str | None = None
) -> DataFrame:
    """Largest value and its name among metrics whose name ends in one of ``suffixes``."""
    mine = of_job(metrics, job, ["job_id", "job"]).where(_name_ends_with(suffixes))
    top = F.max(F.struct(F.col("metric_value").alias("v"), F.col("name").alias("n")))
    return mine.groupBy(*keys).agg(top.alias("t")).select(
        *keys, F.col("t.v").alias("max_value"), F.col("t.n").alias("metric_name")
    )


# ---------------------------------------------------------------- fixed values
REPORTER_METRICS = {
    "checkpoint_duration_ms": ("lastCheckpointDuration",),
    "checkpoint_alignment_time_ms": (
        "lastCheckpointAlignmentDuration",
        "checkpointAlignmentTime",
        "alignmentDuration",
    ),
    "checkpoint_alignment_buffered_bytes": ("lastCheckpointAlignmentBuffered",),
    "checkpoint_failed_count": ("numberOfFailedCheckpoints",),
    "backpressured_time_ms_per_second": ("backPressuredTimeMsPerSecond",),
    "is_backpressured": ("isBackPressured",),
    "busy_time_ms_per_second": ("busyTimeMsPerSecond",),
}
NANOSECOND_METRIC = "checkpointalignmenttime"
SOURCE_LAG_TOKENS = ("recordslagmax", "pendingrecords")
SOURCE_TOKENS = (*SOURCE_LAG_TOKENS, "currentoffsets", "committedoffsets")
CONNECTOR_TARGETS = {
    "total_events_seen": "totalnumberofeventsseen",
    "milliseconds_since_last_event": "millisecondssincelastevent",
    "queue_remaining_capacity": "queueremainingcapacity",
    "number_of_committed_transactions": "numberofcommittedtransactions",
}
# ------------------------------------------------------------------------------


def reporter_snapshot(metrics: DataFrame, keys: Sequence[str], job: str | None = None) -> DataFrame:
    """Per key: the largest value of every reporter metric, and the pressure indicator."""
    mine = of_job(metrics, job, ["job_id", "job"])
    tops = []
    for name, suffixes in REPORTER_METRICS.items():
        pick = F.when(_name_ends_with(suffixes), F.struct("metric_value", "name"))
        tops.append(F.max(pick).alias(f"__{name}"))
    wide = mine.groupBy(*keys).agg(*tops)
    out = [F.col(k) for k in keys]
    for name in REPORTER_METRICS:
        value = F.col(f"__{name}.metric_value")
        if name == "checkpoint_alignment_time_ms":
            nanos = F.endswith(metric_key(F.col(f"__{name}.name")), F.lit(NANOSECOND_METRIC))
            value = F.when(nanos, value / 1e6).otherwise(value)
        out.append(value.alias(name))
    return wide.select(*out).withColumn(
        "backpressure_indicator",
        backpressure_indicator(
            F.col("backpressured_time_ms_per_second"),
            F.col("is_backpressured"),
            F.col("busy_time_ms_per_second"),
        ),
    )


def backpressure_indicator(pressured_ms: Column, flag: Column, busy_ms: Column) -> Column:
    """Share of time under pressure: explicit ratio, else flag, else busy ratio, else 0 or null."""
    explicit = clamp(pressured_ms / 1000.0, 0.0, 1.0)
    return (
        F.when(explicit > 0, explicit)
        .when(flag > 0, clamp(flag, 0.0, 1.0))
        .when(busy_ms.isNotNull(), clamp(busy_ms / 1000.0, 0.0, 1.0))
        .when(pressured_ms.isNotNull() | flag.isNotNull(), F.lit(0.0))
    )


def _contains_any(tokens: Sequence[str]) -> Column:
    hit = F.lit(False)
    for token in tokens:
        hit = hit | F.contains(metric_key("name"), F.lit(token))
    return hit


def source_metrics(metrics: DataFrame, keys: Sequence[str], job: str | None = None) -> DataFrame:
    """Which source gauges a scrape shows; names are a sorted distinct list.

    A scrape names a handful of gauges: they are made distinct before they meet.
    """
    found = of_job(metrics, job, ["job_id", "jobid"]).where(_contains_any(SOURCE_TOKENS))
    names = found.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"))
    return names.groupBy(*keys).agg(
        F.bool_or(_contains_any(SOURCE_LAG_TOKENS)).alias("lag_metric_present"),
        F.count(F.lit(1)).alias("distinct_names"),
        F.sum("n").alias("samples"),
        F.array_join(F.array_sort(F.collect_list("name")), ",").alias("metric_names"),
    )


def connector_metrics(metrics: DataFrame, keys: Sequence[str], order: str, family: str = "debezium") -> DataFrame:
    """First value per target among the connector's metrics, by line order."""
    mine = metrics.where(F.contains(F.lower("name"), F.lit(family)))
    picks = [
        F.min_by(
            F.when(F.contains(metric_key("name"), F.lit(token)), F.col("metric_value")),
            F.when(F.contains(metric_key("name"), F.lit(token)), F.col(order)),
        ).alias(field)
        for field, token in CONNECTOR_TARGETS.items()
    ]
    return mine.groupBy(*keys).agg(F.count(F.lit(1)).alias("metric_count"), *picks)


# -- sample series --------------------------------------------------------------


def completed_checkpoints(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Completed checkpoints, once per id."""
    return history.where(F.col("status") == "COMPLETED").dropDuplicates([*keys, "id"])


def latest_checkpoint(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        completed_checkpoints(history, keys)
        .groupBy(*keys)
        .agg(
            F.max("id").alias("latest_completed_id"),
            F.max_by("duration_ms", "id").alias("duration_ms"),
            F.max("duration_ms").alias("recent_max_duration_ms"),
        )
    )


def collect_samples(reporter: DataFrame, checkpoints: DataFrame, lags: DataFrame, key: str) -> DataFrame:
    """One row per sample time from reporter, checkpoint and lag readings."""
    return (
        lags.join(reporter, key, "left")
        .join(checkpoints, key, "left")
        .withColumn(
            "duration_ms",
            F.greatest("checkpoint_duration_ms", "duration_ms", "recent_max_duration_ms"),
        )
    )


def phases(samples: DataFrame, baseline_samples: int) -> DataFrame:
    """baseline for the first samples, then backpressure while there is lag, else recovery."""
    return samples.withColumn(
        "phase",
        F.when(F.col("sample_index") < baseline_samples, "baseline")
        .when(F.col("lag_events") > 0, "backpressure")
        .otherwise("recovery"),
    )


def zero_lag_runs(samples: DataFrame, keys: Sequence[str], width: int = 65_536) -> DataFrame:
    """Per sample the number of zero-lag samples in a row up to it, and whether it is enough."""
    marked = samples.withColumn("__busy", F.when(F.col("lag_events") > 0, 1).otherwise(0))
    block = floor_div(F.col("sample_index"), width)
    numbered = blocked.row_number(marked, keys, ["sample_index"], block, "__pos")
    numbered = numbered.withColumn(
        "__reset", F.when(F.col("__busy") == 1, F.col("__pos")).otherwise(F.lit(0))
    )
    runs = blocked.running(
        numbered, keys, ["sample_index"], block, [blocked.Running("__last", "max", "__reset")]
    )
    return (
        runs.withColumn("zero_run", F.col("__pos") - F.col("__last"))
        .withColumn("recovered", F.col("zero_run") >= RECOVERED_AFTER)
        .drop("__busy", "__pos", "__reset", "__last")
    )


def state_transitions(
    samples: DataFrame, keys: Sequence[str], order: str, state: str, width: int = 65_536
) -> DataFrame:
    """Samples whose state differs from the sample before."""
    stepped = blocked.running(
        samples.withColumn("__one", F.lit(1)),
        keys,
        [order],
        floor_div(F.col(order), width),
        [blocked.Running("previous_state", "lag", state), blocked.Running("__seen", "sum", "__one")],
    )
    return stepped.where(
        (F.col("__seen") == 1) | ~F.col(state).eqNullSafe(F.col("previous_state"))
    ).drop("__one", "__seen")


def load_summary(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Baseline and load maxima, peaks and the last lag of a sample series."""
    base = F.col("phase") == "baseline"

    def top(column: str, when: Column) -> Column:
        return F.max(F.when(when, F.col(column)))

    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        top("duration_ms", base).alias("baseline_duration_ms"),
        top("duration_ms", ~base).alias("load_duration_ms"),
        top("alignment_ms", base).alias("baseline_alignment_ms"),
        top("alignment_ms", ~base).alias("load_alignment_ms"),
        top("indicator", ~base).alias("peak_indicator"),
        top("lag_events", ~base).alias("peak_lag"),
        # samples sharing the last index: the largest lag counts
        F.max_by("lag_events", F.struct("sample_index", "lag_events")).alias("final_lag"),
        F.max("failed_count").alias("failed_count"),
    )


def load_checks(min_indicator: float) -> dict[str, Column]:
    """Checks over a ``load_summary`` row."""
    none = F.lit(0.0)
    return {
        "checkpoint_duration_rose": F.col("load_duration_ms") > F.col("baseline_duration_ms"),
        "alignment_time_rose": F.col("load_alignment_ms") > F.col("baseline_alignment_ms"),
        "checkpoint_failure_count_recorded": F.col("failed_count").isNotNull(),
        "backpressure_observed": F.coalesce("peak_indicator", none) >= min_indicator,
        "commit_lag_observed": F.coalesce(F.col("peak_lag"), F.lit(0)) > 0,
        "lag_recovered": F.col("final_lag") == 0,
    }


def observability_summary(samples: DataFrame) -> DataFrame:
    """Counts over sampler rows (lag_sum, lag_metric_present, connector_present, scrape_error)."""
    return samples.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count("lag_sum").alias("lag_sample_count"),
        F.count_if(F.col("lag_sum").isNotNull() & F.col("lag_metric_present")).alias(
            "prometheus_lag_sample_count"
        ),
        F.count_if("connector_present").alias("connector_sample_count"),
        F.coalesce(F.max("lag_sum"), F.lit(0)).alias("max_group_lag"),
        F.count("scrape_error").alias("scrape_error_sample_count"),
    )


def observed_metric_names(metrics: DataFrame, families: Mapping[str, Column]) -> DataFrame:
    """One row: per family the distinct names of its metrics, sorted and comma separated.

    ``families`` maps a name to the condition on a metric sample. The names of an exporter are a
    fixed set, however many samples there are.
    """
    seen = metrics.groupBy("name").agg(*[F.bool_or(F.coalesce(hit, F.lit(False))).alias(f"__{f}") for f, hit in families.items()])
    return seen.agg(
        *[F.array_join(F.array_sort(F.collect_list(F.when(F.col(f"__{f}"), F.col("name")))), ",").alias(f) for f in families]
    )


def recovery_by_class(runs: DataFrame) -> DataFrame:
    """Slowest recovery per failure class, and whether every run ended at zero diff."""
    return runs.groupBy("failure_class").agg(
        F.count(F.lit(1)).alias("runs"),
        F.max("recovery_seconds").alias("max_recovery_seconds"),
        F.every(F.col("snapshot_diff_count") == 0).alias("all_diffs_zero"),
    )


def slo_gate(measurements: DataFrame) -> DataFrame:
    """(measurement, measured) rows against the fixed budgets."""
    limits = F.create_map(*[x for k, v in BUDGETS.items() for x in (F.lit(k), F.lit(v[0]))])
    at_least = [k for k, v in BUDGETS.items() if v[1] == "at_least"]
    budget = limits[F.col("measurement")]
    ok = F.when(F.col("measurement").isin(at_least), F.col("measured") >= budget).otherwise(
        F.col("measured") <= budget
    )
    return measurements.where(budget.isNotNull()).select(
        "measurement", "measured", budget.alias("budget"), F.coalesce(ok, F.lit(False)).alias("passed")
    )
