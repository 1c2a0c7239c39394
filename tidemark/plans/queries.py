"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import blocked
from tidemark.functions.columns import (
    floor_div,
    metric_key,
    text_row,
    ts_text,
    tsv_line,
)
from tidemark.functions.digests import multiset_digest, ordered_digest
from tidemark.operators import (
    audits,
    contracts,
    diff,
    maintenance,
    measures,
    offsets,
    quality,
    replay,
    state,
)
from tidemark.operators.decode import (
    changes,
    dead_letter_json,
    dead_letters,
    decode,
    poison_records,
    to_current_rows,
)
from tidemark.operators.encode import snapshot_then_log
from tidemark.plans import fixtures as fx
from tidemark.schemas import CHANGELOG_COLUMNS, DEAD_LETTER, ORDER_COLUMNS
from tidemark.session import scratch_dir
from tidemark.sources import cdc_log, reports, runs, tables, workload
from tidemark.streaming import coalesce, jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PER_COMMIT = 1000  # offsets per commit in the batch-only time travel queries
UNLOGGED = 1_000_000_000_000  # order ids from here on are in a snapshot only
RECORDS_PER_FILE = 50_000
FILES_PER_BATCH = 8  # log files per micro-batch at least, one task each
MOST_BATCHES = 12  # of a bounded log: what a batch costs by itself must not grow with the log


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.current_state(fx.changelog_table(spark, sf_dir))


def _text(df: DataFrame) -> DataFrame:
    """Rows with the timestamp as text and integer widths as stored."""
    return df.withColumn("updated_at", ts_text("updated_at"))


def _half_time(spark: SparkSession, sf_dir: str) -> int:
    """A timestamp in the middle of the log."""
    span = fx.log_table(spark, sf_dir).agg(F.max("timestamp_ms").alias("t")).first()
    return fx.BASE_MS + (span.t - fx.BASE_MS) // 2


# -- decoding and state ---------------------------------------------------------


@query
def decode_changelog(spark, sf_dir):
    images = changes(decode(fx.log_table(spark, sf_dir)))
    return _text(images.select("partition", "offset", "image_seq", *CHANGELOG_COLUMNS))


@query
def decode_strictness(spark, sf_dir):
    """Outcome per accepted or rejected wire form."""
    return decode(fx.odd_values(spark, sf_dir)).select(
        "offset",
        F.col("error.error_type").alias("error_type"),
        F.col("image.row.order_id").alias("order_id"),
        F.col("image.row.status").alias("status"),
        F.date_format("image.row.updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"),
    )


@query
def source_snapshot(spark, sf_dir):
    return fx.source_orders(spark, sf_dir).select(*text_row())


@query
def current_rows_applied(spark, sf_dir):
    """Images the current table applies, per row kind."""
    rows = to_current_rows(fx.changelog_table(spark, sf_dir))
    return rows.groupBy("cdc_row_kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("cents")
    )


@query
def current_state(spark, sf_dir):
    return _text(_current(spark, sf_dir))


@query
def current_as_of(spark, sf_dir):
    """The state at the commit in the middle of the log."""
    images = fx.changelog_table(spark, sf_dir).withColumn(
        "commit_id", floor_div(F.col("offset"), PER_COMMIT)
    )
    newest = images.agg(F.max("commit_id").alias("c")).first().c
    return _text(state.current_state_as_of(images, "commit_id", newest // 2))


@query
def snapshot_then_changes(spark, sf_dir):
    """An initial snapshot with old amounts and orders the log never mentions, then the log.

    The log lies on one partition, which is none that the snapshot could have guessed.
    """
    orders = fx.source_orders(spark, sf_dir)
    old = orders.withColumn("amount_cents", F.col("amount_cents") + 1)
    unlogged = orders.withColumn("order_id", F.col("order_id") + UNLOGGED)
    moved = fx.log_table(spark, sf_dir).withColumn("partition", F.lit(0))
    log = snapshot_then_log(old.unionByName(unlogged), moved, fx.TOPIC, F.lit(fx.BASE_MS))
    return _text(state.current_state(changes(decode(log))))


@query
def changelog_lines(spark, sf_dir):
    """TSV form of the changelog, nulls spelled out."""
    return fx.changelog_table(spark, sf_dir).select(
        "partition",
        "offset",
        "image_seq",
        tsv_line(
            F.col("order_id"), F.col("status"), ts_text("updated_at"), F.nullif(F.col("cdc_operation"), F.lit("delete"))
        ).alias("line"),
    )


@query
def adhoc_sql(spark, sf_dir):
    """Free SQL over both tables."""
    fx.changelog_table(spark, sf_dir).createOrReplaceTempView("orders_changelog")
    _current(spark, sf_dir).createOrReplaceTempView("orders_current")
    return spark.sql(
        """
        SELECT c.status, count(DISTINCT c.order_id) AS live_orders, count(*) AS images,
               sum(CASE WHEN l.cdc_row_kind = '+U' THEN 1 ELSE 0 END) AS updates
        FROM orders_current c JOIN orders_changelog l ON c.order_id = l.order_id
        GROUP BY c.status
        """
    )


# -- reconciliation -------------------------------------------------------------


@query
def reconcile_current(spark, sf_dir):
    row = diff.reconcile(fx.source_orders(spark, sf_dir), _current(spark, sf_dir), ORDER_COLUMNS)
    return row.select(
        "diff_count",
        "missing_rows",
        "unexpected_rows",
        "expected_rows",
        "actual_rows",
        (F.col("expected_digest") == F.col("actual_digest")).alias("digests_match"),
    )


def _corrupted(rows: DataFrame) -> DataFrame:
    """A wrong amount in every fiftieth row, and one row in a hundred gone."""
    k = F.col("order_id")
    return rows.where(k % 100 != 31).withColumn(
        "amount_cents", F.when(k % 50 == 7, F.col("amount_cents") + 1).otherwise(F.col("amount_cents"))
    )


@query
def row_diff_corrupted(spark, sf_dir):
    return _text(
        diff.row_diff(
            fx.source_orders(spark, sf_dir), _corrupted(_current(spark, sf_dir)), ORDER_COLUMNS
        )
    )


@query
def row_diff_all_corrupted(spark, sf_dir):
    current = _current(spark, sf_dir)
    copies = F.when(F.col("order_id") % 50 == 9, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    doubled = current.withColumn("__copy", F.explode(copies)).drop("__copy")
    return _text(diff.row_diff_all(fx.source_orders(spark, sf_dir), doubled, ORDER_COLUMNS))


@query
def row_diff_by_key(spark, sf_dir):
    return diff.row_diff_by_key(
        fx.source_orders(spark, sf_dir), _corrupted(_current(spark, sf_dir)), "order_id", ORDER_COLUMNS[1:]
    )


@query
def two_path_parity(spark, sf_dir):
    """Source, table route and log route against each other."""
    source = fx.source_orders(spark, sf_dir)
    path_a = _current(spark, sf_dir)
    path_b = replay.rebuild(fx.log_table(spark, sf_dir))
    pairs = {"source_vs_a": (source, path_a), "source_vs_b": (source, path_b), "a_vs_b": (path_a, path_b)}
    out = None
    for name, (left, right) in pairs.items():
        row = diff.reconcile(left, right, ORDER_COLUMNS).select(
            F.lit(name).alias("pair"), "diff_count", "expected_rows", "actual_rows"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query
def snapshot_digest(spark, sf_dir):
    return multiset_digest(_current(spark, sf_dir), text_row())


@query
def ordered_snapshot_digest(spark, sf_dir):
    return ordered_digest(_current(spark, sf_dir), "order_id", text_row())


@query
def membership(spark, sf_dir):
    """Deleted keys absent, updated keys present with their new status."""
    images = fx.changelog_table(spark, sf_dir)
    current = _current(spark, sf_dir)
    deleted = images.where(F.col("cdc_row_kind") == "-D").select("order_id").distinct()
    updated = images.where(F.col("cdc_row_kind") == "+U").select("order_id", "status").distinct()
    still_there = deleted.join(current, "order_id", "left_semi")
    alive = updated.join(deleted, "order_id", "left_anti")
    stale = alive.join(current, ["order_id", "status"], "left_anti")
    count = F.count(F.lit(1)).cast("bigint")
    return (
        deleted.agg(F.lit("deleted_keys").alias("check_name"), count.alias("n"))
        .unionByName(still_there.agg(F.lit("deleted_but_visible").alias("check_name"), count.alias("n")))
        .unionByName(alive.agg(F.lit("updated_and_alive").alias("check_name"), count.alias("n")))
        .unionByName(stale.agg(F.lit("updated_but_stale").alias("check_name"), count.alias("n")))
    )


# -- duplicates -----------------------------------------------------------------


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 decoded: every image delivered twice."""
    return fx.changelog_table(spark, sf_dir).withColumn("epoch", F.explode(F.array(F.lit(1), F.lit(2))))


@query
def duplicate_event_ids(spark, sf_dir):
    return audits.duplicate_event_ids(_doubled(spark, sf_dir))


@query
def duplicate_occurrences(spark, sf_dir):
    once = audits.duplicate_counts(fx.changelog_table(spark, sf_dir))
    twice = audits.duplicate_counts(_doubled(spark, sf_dir))
    return once.withColumn("deliveries", F.lit(1)).unionByName(twice.withColumn("deliveries", F.lit(2)))


@query
def record_identity_dups(spark, sf_dir):
    return audits.record_duplicates(_doubled(spark, sf_dir)).drop("topic")


@query
def redelivery_audit(spark, sf_dir):
    doubled = _doubled(spark, sf_dir)
    return audits.redelivery_audit(doubled, state.current_state(doubled))


@query
def replay_targets(spark, sf_dir):
    """Targets of a full replay of the changelog, from its measured counts."""
    images = fx.changelog_table(spark, sf_dir)
    per_image = images.groupBy("partition", "offset", "image_seq").agg(F.count(F.lit(1)).alias("n"))
    measured = per_image.agg(
        F.sum("n").alias("changelog_rows"),
        F.sum(F.col("n") - 1).alias("duplicate_occurrences"),
        F.count(F.lit(1)).alias("replayed"),
    )
    return audits.replay_targets(measured)


@query
def event_id_audit(spark, sf_dir):
    return audits.event_id_audit(
        fx.source_orders(spark, sf_dir), _current(spark, sf_dir), fx.changelog_table(spark, sf_dir)
    )


# -- ordering and keys ----------------------------------------------------------


def _rising(images: DataFrame) -> DataFrame:
    return images.where(F.col("cdc_row_kind").isin("+I", "+U"))


@query
def monotonic_violations(spark, sf_dir):
    probe = audits.monotonic_violations(
        fx.probe_table(spark, sf_dir),
        ["timestamp_ms", "partition", "offset"],
        floor_div(F.col("timestamp_ms"), 60_000),
    )
    return probe


@query
def main_log_order(spark, sf_dir):
    """The same law over the main log: no violations there."""
    per_key = audits.monotonic_violations(
        _rising(fx.changelog_table(spark, sf_dir)),
        ["partition", "offset", "image_seq"],
        F.struct("partition", floor_div(F.col("offset"), fx.BLOCK)),
    )
    return per_key.agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("records").alias("records"),
        F.sum("violations").alias("violations"),
    )


@query
def offsets_increase(spark, sf_dir):
    """Per log partition: records and timestamp steps at which the offset does not rise."""
    log = fx.log_table(spark, sf_dir).select("partition", "offset", "timestamp_ms")
    stepped = blocked.lag(
        log, ["partition"], ["timestamp_ms", "offset"], floor_div(F.col("timestamp_ms"), 60_000_000), "offset", "prev"
    )
    return stepped.groupBy("partition").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("offset") <= F.col("prev")).alias("violations")
    )


@query
def miskey_audit(spark, sf_dir):
    return audits.miskey_audit(fx.probe_table(spark, sf_dir))


@query
def partitions_per_key(spark, sf_dir):
    return audits.partitions_per_key(fx.probe_table(spark, sf_dir))


@query
def admission_gate(spark, sf_dir):
    probe = fx.probe_table(spark, sf_dir)
    return audits.admission_gate(probe, audits.miskey_audit(probe)).select(
        "order_id", "event_id", "partition", "offset", "admitted"
    )


# -- quarantine -----------------------------------------------------------------


@query
def dead_letter_rows(spark, sf_dir):
    letters = dead_letters(decode(fx.poisoned_log(spark, sf_dir)), F.lit("2026-01-01T00:00:00.000Z"))
    opened = replay.open_dead_letters(letters)
    return opened.select(
        "dlq_schema_version",
        F.col("original_partition").alias("partition"),
        F.col("original_offset").alias("offset"),
        F.col("original_timestamp_ms").alias("timestamp_ms"),
        F.unbase64("original_key_base64").cast("string").alias("record_key"),
        "error_type",
        F.col("repair.intended_after.order_id").alias("intended_order_id"),
        F.col("repair.intended_operation").alias("intended_operation"),
        "repairable",
    )


@query
def dead_letter_wire(spark, sf_dir):
    """Wire JSON of the dead letters, read back."""
    letters = dead_letters(decode(fx.poisoned_log(spark, sf_dir)), F.lit("2026-01-01T00:00:00.000Z"))
    back = F.from_json("value", DEAD_LETTER)
    return dead_letter_json(letters).select(back.alias("d")).select(
        F.col("d.dlq_schema_version").alias("dlq_schema_version"),
        F.col("d.quarantined_at").alias("quarantined_at"),
        F.col("d.original_partition").alias("partition"),
        F.col("d.original_offset").alias("offset"),
        F.col("d.error_type").alias("error_type"),
    )


@query
def dlq_audit(spark, sf_dir):
    log = fx.stored(spark, sf_dir, "poisoned", fx.poisoned_log)
    letters = dead_letters(decode(log))
    twice = letters.withColumn("__d", F.explode(F.array(F.lit(1), F.lit(2)))).drop("__d")
    return audits.dlq_audit(twice, log)


@query
def dlq_state_gap(spark, sf_dir):
    """Differences before repair, after repair in place, and after a wrong repair at the tail."""
    source = fx.source_orders(spark, sf_dir)
    decoded = decode(fx.stored(spark, sf_dir, "poisoned", fx.poisoned_log))
    images, letters = changes(decoded), dead_letters(decoded)
    fixed = changes(decode(replay.repaired_records(letters)))
    stages = {
        "before_repair": images,
        "repaired_in_place": images.unionByName(fixed),
        "repaired_at_tail": images.unionByName(fixed.withColumn("offset", F.col("offset") + (1 << 40))),
    }
    out = None
    for name, rows in stages.items():
        row = diff.reconcile(source, state.current_state(rows), ORDER_COLUMNS).select(
            F.lit(name).alias("stage"), "missing_rows", "unexpected_rows"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query
def dlq_repair(spark, sf_dir):
    decoded = decode(fx.stored(spark, sf_dir, "poisoned", fx.poisoned_log))
    images, _ = replay.repair_and_replay(changes(decoded), dead_letters(decoded))
    return _text(state.current_state(images))


@query
def poison_rate(spark, sf_dir):
    decoded = decode(fx.odd_values(spark, sf_dir))
    return poison_records(decoded).groupBy("error.error_type").agg(F.count(F.lit(1)).alias("n"))


@query
def wire_header_audit(spark, sf_dir):
    known = spark.range(100, 105).select(F.col("id").alias("schema_id"))
    return contracts.wire_audit(fx.wire_values(spark, sf_dir), known)


# -- offsets and replay ---------------------------------------------------------


def _lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.log_table(spark, sf_dir)
    return offsets.group_lag(fx.end_offsets(log), fx.group_offsets(log))


@query
def group_lag(spark, sf_dir):
    return _lags(spark, sf_dir)


@query
def lag_summary(spark, sf_dir):
    return offsets.lag_summary(_lags(spark, sf_dir))


@query
def offsets_for_timestamp(spark, sf_dir):
    return cdc_log.offsets_for_timestamp(
        fx.log_table(spark, sf_dir), _half_time(spark, sf_dir)
    ).drop("topic")


@query
def rebuild_from_zero(spark, sf_dir):
    rebuilt = replay.rebuild(fx.log_table(spark, sf_dir))
    return diff.reconcile(_current(spark, sf_dir), rebuilt, ORDER_COLUMNS).select(
        "diff_count",
        "actual_rows",
        (F.col("expected_digest") == F.col("actual_digest")).alias("digests_match"),
    )


@query
def rebuild_from_timestamp(spark, sf_dir):
    return _text(replay.rebuild_from_timestamp(fx.log_table(spark, sf_dir), _half_time(spark, sf_dir)))


@query
def timestamp_coverage(spark, sf_dir):
    return replay.timestamp_coverage(
        _current(spark, sf_dir), fx.changelog_table(spark, sf_dir), _half_time(spark, sf_dir)
    )


@query
def append_positions(spark, sf_dir):
    """Offsets new records get behind the log: one per customer."""
    new = fx.table(spark, sf_dir, "customer").select(
        F.lit(fx.TOPIC).alias("topic"),
        (F.col("c_custkey") % fx.PARTITIONS).cast("int").alias("partition"),
        F.col("c_custkey"),
    )
    placed = cdc_log.assign_offsets(
        fx.log_table(spark, sf_dir), new, ["c_custkey"], floor_div(F.col("c_custkey"), fx.BLOCK)
    )
    return placed.select("c_custkey", "partition", "offset")


@query
def first_log_records(spark, sf_dir):
    """Bounded read in (partition, offset) order; the bound is the feature."""
    return cdc_log.first_records(
        fx.log_table(spark, sf_dir).select("partition", "offset", F.col("key").cast("string").alias("record_key")), 100
    )


@query
def linkage(spark, sf_dir):
    """Runs stand per customer: offsets, checkpoint and snapshots of its orders."""
    o = fx.orders(spark, sf_dir).withColumn("run_id", F.col("o_custkey"))
    status = F.col("o_orderstatus")
    lags = o.groupBy("run_id", (F.col("k") % 3).alias("partition")).agg(
        F.count_if(status == "P").alias("lag")
    )
    checkpoints = o.where(status == "O").select("run_id", F.col("k").alias("checkpoint_id"))
    snapshots = (
        o.where(status != "P")
        .groupBy("run_id", F.when(status == "F", "orders_current").otherwise("orders_changelog").alias("table_name"))
        .agg(F.max("k").alias("snapshot_id"))
    )
    return offsets.linkage(lags, checkpoints, snapshots)


@query
def commit_lag(spark, sf_dir):
    """Changelog as of an early commit behind the source."""
    images = fx.changelog_table(spark, sf_dir).where(
        F.col("cdc_row_kind").isin("+I") & (F.col("timestamp_ms") < _half_time(spark, sf_dir))
    )
    return measures.commit_lag(fx.source_orders(spark, sf_dir), images)


# -- snapshots ------------------------------------------------------------------


def _histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.event_snapshots(spark, sf_dir)
    return s.select(
        F.explode(F.array(F.lit("orders_current"), F.lit("orders_changelog"))).alias("table_name"), "*"
    )


@query
def snapshot_history(spark, sf_dir):
    return fx.event_snapshots(spark, sf_dir).orderBy("committed_at_epoch_ms", "snapshot_id")


@query
def latest_snapshots(spark, sf_dir):
    histories = _histories(spark, sf_dir)
    return tables.latest_snapshots(histories, histories.select("table_name"))


@query
def snapshot_summary(spark, sf_dir):
    files = fx.table(spark, sf_dir, "events").select(
        F.lit("orders_current").alias("table_name"),
        (floor_div(F.col("event_id"), 500) + 1).alias("snapshot_id"),
        F.when(F.col("event_type") == "error", "deletes").otherwise("data").alias("content"),
    )
    return tables.snapshot_summary(_histories(spark, sf_dir), files)


# -- freshness and throughput ---------------------------------------------------


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.freshness_samples(
        fx.visible_events(spark, sf_dir), fx.event_snapshots(spark, sf_dir), fx.event_batches(spark, sf_dir)
    )


@query
def commit_batches(spark, sf_dir):
    return fx.event_batches(spark, sf_dir)


@query
def events_in_batches(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("event_id")
    return measures.events_in_batches(events, fx.event_batches(spark, sf_dir), "event_id").select(
        "event_id", "batch_id"
    )


@query
def newly_visible(spark, sf_dir):
    return (
        measures.first_visible(fx.visible_events(spark, sf_dir))
        .groupBy("snapshot_id")
        .agg(
            F.count(F.lit(1)).alias("new_events"),
            F.min("event_id").alias("first_event_id"),
            F.max("event_id").alias("last_event_id"),
        )
    )


@query
def freshness(spark, sf_dir):
    return measures.freshness(_samples(spark, sf_dir))


@query
def freshness_buckets(spark, sf_dir):
    return measures.freshness_buckets(_samples(spark, sf_dir))


@query
def freshness_problems(spark, sf_dir):
    return measures.freshness_problems(_samples(spark, sf_dir), fx.table(spark, sf_dir, "events"))


def _throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    recovered = fx.event_snapshots(spark, sf_dir).select(F.col("committed_at_epoch_ms").alias("recovered_ms"))
    return measures.throughput(fx.event_batches(spark, sf_dir), recovered)


@query
def throughput(spark, sf_dir):
    return _throughput(spark, sf_dir)


@query
def slo_gate(spark, sf_dir):
    rates = _throughput(spark, sf_dir).select(
        F.inline(
            F.array(
                F.struct(F.lit("end_to_end_rows_per_second").alias("measurement"), F.col("end_to_end_rows_per_second").alias("measured")),
                F.struct(F.lit("end_to_end_seconds").alias("measurement"), F.col("end_to_end_seconds").alias("measured")),
            )
        )
    )
    waits = measures.freshness(_samples(spark, sf_dir)).select(
        F.inline(
            F.array(
                F.struct(F.lit("freshness_p50_ms").alias("measurement"), F.col("p50_ms").cast("double").alias("measured")),
                F.struct(F.lit("freshness_p95_ms").alias("measurement"), F.col("p95_ms").cast("double").alias("measured")),
            )
        )
    )
    recoveries = measures.recovery_by_class(fx.drill_runs(spark, sf_dir)).select(
        F.concat(F.lit("recovery_"), F.regexp_replace("failure_class", "-", "_"), F.lit("_seconds")).alias("measurement"),
        F.col("max_recovery_seconds").alias("measured"),
    )
    return measures.slo_gate(rates.unionByName(waits).unionByName(recoveries))


# -- metrics and samples --------------------------------------------------------


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.parse_metrics(fx.metric_lines(spark, sf_dir))


@query
def metric_samples(spark, sf_dir):
    return _metrics(spark, sf_dir).select(
        "event_id", "name", F.col("labels")["job_id"].alias("job"), F.col("labels")["task"].alias("task"), "metric_value"
    )


@query
def metric_max(spark, sf_dir):
    return measures.max_metric(_metrics(spark, sf_dir), ["busyTimeMsPerSecond"], ["scrape"])


@query
def metric_max_of_job(spark, sf_dir):
    return measures.max_metric(
        _metrics(spark, sf_dir), ["lastCheckpointAlignmentDuration", "checkpointAlignmentTime"], job="1"
    )


@query
def backpressure(spark, sf_dir):
    """Reporter snapshot per scrape with the pressure indicator."""
    return measures.reporter_snapshot(_metrics(spark, sf_dir), ["scrape"]).select(
        "scrape",
        "checkpoint_alignment_time_ms",
        "backpressured_time_ms_per_second",
        "busy_time_ms_per_second",
        "backpressure_indicator",
    )


@query
def source_metrics(spark, sf_dir):
    return measures.source_metrics(_metrics(spark, sf_dir), ["scrape"], job="1")


@query
def connector_metrics(spark, sf_dir):
    return measures.connector_metrics(_metrics(spark, sf_dir), ["scrape"], "event_id").select(
        "scrape", "metric_count", "total_events_seen", "queue_remaining_capacity"
    )


@query
def metric_keys(spark, sf_dir):
    return _metrics(spark, sf_dir).groupBy(metric_key("name").alias("metric_key")).agg(F.count(F.lit(1)).alias("n"))


def _phased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.phases(fx.load_samples(spark, sf_dir), 3)


@query
def sample_phases(spark, sf_dir):
    return _phased(spark, sf_dir).select("series", "sample_index", "lag_events", "phase")


@query
def zero_lag_runs(spark, sf_dir):
    return measures.zero_lag_runs(fx.load_samples(spark, sf_dir), ["series"]).select(
        "series", "sample_index", "lag_events", "zero_run", "recovered"
    )


@query
def state_transitions(spark, sf_dir):
    return measures.state_transitions(
        _phased(spark, sf_dir).select("series", "sample_index", "phase"), ["series"], "sample_index", "phase"
    )


@query
def user_state_transitions(spark, sf_dir):
    """The same over every event of a user, where groups are long."""
    events = fx.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return measures.state_transitions(events, ["user_id"], "event_id", "event_type")


@query
def load_summary(spark, sf_dir):
    return measures.load_summary(_phased(spark, sf_dir), ["series"])


@query
def load_checks(spark, sf_dir):
    return audits.checks_of(measures.load_summary(_phased(spark, sf_dir)), measures.load_checks(0.05))


@query
def check_suite(spark, sf_dir):
    checks = audits.checks_of(measures.load_summary(_phased(spark, sf_dir)), measures.load_checks(0.05))
    gate = audits.checks_of(
        audits.event_id_audit(
            fx.source_orders(spark, sf_dir), _current(spark, sf_dir), fx.changelog_table(spark, sf_dir)
        ),
        {"event_ids_match": F.col("current_event_ids_match")},
    )
    return audits.check_suite(checks.unionByName(gate))


@query
def collected_samples(spark, sf_dir):
    """Reporter, checkpoint and lag readings of a day in one row."""
    e = fx.table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    reporter = e.groupBy("day").agg(F.max("value").alias("checkpoint_duration_ms"))
    history = e.select(
        "day",
        F.col("user_id").alias("id"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETED").alias("status"),
        # equal per (day, id), so that any surviving copy is the same
        (F.col("user_id") * 2).cast("double").alias("duration_ms"),
    )
    checkpoints = measures.latest_checkpoint(history, ["day"])
    lags = e.groupBy("day").agg(F.count_if(F.col("event_type") == "error").alias("lag_events"))
    return measures.collect_samples(reporter, checkpoints, lags, "day").select(
        "day", "lag_events", "latest_completed_id", "duration_ms"
    )


@query
def observability_summary(spark, sf_dir):
    e = F.col("event_id")
    samples = fx.table(spark, sf_dir, "events").select(
        F.when(e % 7 != 0, F.col("user_id")).alias("lag_sum"),
        (e % 3 == 0).alias("lag_metric_present"),
        (e % 2 == 0).alias("connector_present"),
        F.when(F.col("event_type") == "error", "timeout").alias("scrape_error"),
    )
    return measures.observability_summary(samples)


@query
def recovery_by_class(spark, sf_dir):
    return measures.recovery_by_class(fx.drill_runs(spark, sf_dir))


@query
def suite_summary(spark, sf_dir):
    return audits.suite_summary(fx.drill_runs(spark, sf_dir))


# -- reports --------------------------------------------------------------------


@query
def end_offset_report(spark, sf_dir):
    """Offset report lines, one per customer, among lines of another topic."""
    c = F.col("c_custkey")
    lines = fx.table(spark, sf_dir, "customer").select(
        F.concat(
            F.when(c % 4 == 3, "other").otherwise("shop.orders"),
            F.lit(":"),
            c.cast("string"),
            F.lit(":"),
            F.when(c % 10 == 0, "oops").otherwise((c * 3).cast("string")),
        ).alias("value")
    )
    return reports.parse_end_offsets(lines, "shop.orders")


@query
def group_offset_report(spark, sf_dir):
    c = F.col("c_custkey")
    lines = fx.table(spark, sf_dir, "customer").select(
        F.concat_ws(
            "   ",
            F.when(c % 4 == 3, "other").otherwise("readers"),
            F.lit("shop.orders"),
            c.cast("string"),
            F.when(c % 10 == 0, "-").otherwise((c * 2).cast("string")),
            (c * 3).cast("string"),
            F.when(c % 10 == 0, "-").otherwise(c.cast("string")),
            F.lit("consumer-1"),
        ).alias("value")
    )
    return reports.parse_group_offsets(lines, "readers", "shop.orders")


@query
def reset_report(spark, sf_dir):
    """Several rows on one physical line."""
    s = F.col("c_custkey").cast("string")
    lines = fx.table(spark, sf_dir, "customer").select(
        F.concat(
            F.lit("GROUP TOPIC PARTITION NEW-OFFSET readers shop.orders "), s, F.lit(" 0 readers other "), s,
            F.lit(" 7 readers shop.orders "), (F.col("c_custkey") + 1_000_000).cast("string"), F.lit(" 5"),
        ).alias("value")
    )
    return reports.parse_reset_offsets(lines, "readers", "shop.orders")


@query
def connector_states(spark, sf_dir):
    s = F.col("s_suppkey")
    doc = F.to_json(
        F.struct(
            F.struct(F.when(s % 5 == 0, "PAUSED").otherwise("RUNNING").alias("state")).alias("connector"),
            F.array(
                F.struct(
                    F.lit(0).alias("id"),
                    F.when(s % 3 == 0, "FAILED").otherwise("RUNNING").alias("state"),
                    F.when(s % 3 == 0, F.concat(F.lit("java.io.IOException: secret "), s.cast("string"))).alias("trace"),
                ),
                F.struct(F.lit(1).alias("id"), F.lit("RUNNING").alias("state"), F.lit("").alias("trace")),
            ).alias("tasks"),
        )
    )
    return reports.connector_states(
        fx.table(spark, sf_dir, "supplier").select("s_suppkey", doc.alias("value"))
    )


def _checkpoint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    doc = F.to_json(
        F.struct(
            e.alias("id"),
            (e % 2 == 0).alias("savepoint"),
            v.cast("string").alias("end_to_end_duration"),
            F.struct(
                F.struct((v * 2).alias("max_duration"), v.alias("min_buffered")).alias("alignment"),
                F.array((e % 10).alias("a"), (e % 7).alias("b")).alias("start_delay"),
            ).alias("tasks"),
        )
    )
    return fx.table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))


@query
def numeric_paths(spark, sf_dir):
    return reports.flatten_numeric_paths(_checkpoint_documents(spark, sf_dir), "doc")


@query
def max_path_numbers(spark, sf_dir):
    leaves = reports.flatten_numeric_paths(_checkpoint_documents(spark, sf_dir), "doc")
    wanted = {"alignment_ms": (["alignment"], ["duration"]), "start_delay_ms": (["start", "delay"], [])}
    return reports.max_path_numbers(leaves, ["event_id"], wanted)


# -- contracts ------------------------------------------------------------------


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.registry_fields(fx.schema_registry(spark, sf_dir))


@query
def schema_fields(spark, sf_dir):
    return _fields(spark, sf_dir).select("subject", "version", "field", "has_default")


@query
def schema_evolution(spark, sf_dir):
    return contracts.evaluate_evolution(_fields(spark, sf_dir), 1, 2)


@query
def schema_admission(spark, sf_dir):
    """Registry of first versions with the second versions offered."""
    all_versions = fx.schema_registry(spark, sf_dir)
    admitted = contracts.admit_versions(
        all_versions.where(F.col("version") == 1), all_versions.where(F.col("version") == 2)
    )
    return admitted.select("subject", "version")


@query
def schema_mutation(spark, sf_dir):
    mutated = contracts.mutate_types(_fields(spark, sf_dir), "p_partkey", "string")
    return mutated.select(
        "subject", "version", "field", "mutations", (F.col("type") == "string").alias("is_string")
    )


@query
def contract_fingerprints(spark, sf_dir):
    """Subjects whose two versions are the same contract, however their JSON is ordered."""
    prints = contracts.contract_fingerprint(fx.schema_registry(spark, sf_dir))
    return prints.groupBy("subject").agg(
        (F.min("contract_sha256") == F.max("contract_sha256")).alias("same_contract")
    )


# -- files, quality, workloads, ledger ------------------------------------------


@query
def file_stats(spark, sf_dir):
    return maintenance.file_stats(fx.file_listing(spark, sf_dir))


@query
def file_stats_per_manifest(spark, sf_dir):
    return maintenance.file_stats(fx.file_listing(spark, sf_dir).withColumn("source", F.col("manifest")), ["source"])


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.compaction_plan(
        fx.file_listing(spark, sf_dir), ["manifest"], "path", floor_div(F.col("path"), 4096), 16_384
    )


@query
def compaction_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query
def compaction_effect(spark, sf_dir):
    """Small files before against bins after, per source."""
    files = fx.file_listing(spark, sf_dir).where(F.col("size_bytes") < 16_384)
    after = maintenance.plan_summary(_plan(spark, sf_dir), ["manifest"]).select(
        F.col("bin").alias("path"), F.col("bytes").alias("size_bytes"), F.lit("rewritten").alias("manifest"),
        F.col("manifest").alias("source"),
    )
    before = maintenance.file_stats(files.withColumn("source", F.col("manifest")), ["source"])
    stats = maintenance.file_stats(after, ["source"])
    # tasks stand in for the latency here: one scan task per file
    latency = lambda df: df.withColumn("planning_latency_ms", F.col("data_file_count").cast("double"))
    return maintenance.compare_metrics(latency(before), latency(stats), "source")


@query
def key_constraints(spark, sf_dir):
    return quality.key_constraints(fx.source_orders(spark, sf_dir))


@query
def key_constraints_broken(spark, sf_dir):
    """The same over rows of two sources mixed up: keys repeat, texts run too long."""
    source = fx.source_orders(spark, sf_dir)
    clash = source.withColumn("business_key", F.lpad("business_key", 70, "x")).withColumn(
        "event_id", F.col("event_id") + 1
    )
    return quality.key_constraints(source.unionByName(clash.where(F.col("order_id") % 3 == 1)))


@query
def generated_orders(spark, sf_dir):
    """The workload generator over the ids of the order table."""
    ids = fx.orders(spark, sf_dir).select((F.col("k") + 1).alias("id"))
    return _text(workload.order_rows(ids, 10_000, 42))


@query
def spike_workload(spark, sf_dir):
    ids = fx.orders(spark, sf_dir).select((F.col("k") + 1).alias("id"))
    load = workload.spike_rows(ids, 0, "load").withColumn("profile", F.lit("load"))
    small = workload.spike_rows(ids, 0, "compaction").withColumn("profile", F.lit("compaction"))
    return _text(load.unionByName(small))


@query
def ledger_validation(spark, sf_dir):
    logs = spark.range(9).select(F.concat(F.lit("logs/"), F.col("id").cast("string"), F.lit(".log")).alias("path"))
    return runs.validate_ledger(fx.run_documents(spark, sf_dir), logs)


@query
def run_index(spark, sf_dir):
    return runs.run_index(fx.run_documents(spark, sf_dir)).orderBy("name")


# -- streaming ------------------------------------------------------------------


def _per_batch(files: int, most: int = MOST_BATCHES) -> int:
    """Log files per micro-batch, so that a log of any length is read in ``most`` at most."""
    return max(FILES_PER_BATCH, -(-files // most))


def _log_files(records: int, least: int = FILES_PER_BATCH) -> int:
    return max(least, records // RECORDS_PER_FILE)


def _stream_tables(spark: SparkSession, sf_dir: str, name: str, build: Query) -> tuple[tables.TableSet, str, str, int]:
    """The tables, the log, the checkpoint and the log files per micro-batch."""
    root = scratch_dir(spark, name)
    records = build(spark, sf_dir)
    files = _log_files(records.count(), 4 * FILES_PER_BATCH)
    records.repartitionByRange(files, "timestamp_ms", "partition").write.parquet(f"{root}/log")
    return tables.TableSet(spark, f"{root}/tables").ensure(), f"{root}/log", f"{root}/checkpoint", _per_batch(files)


@query
def stream_exactly_once(spark, sf_dir):
    """Several micro-batches with a failure before a commit; current state at the end."""
    t, log, checkpoint, per_batch = _stream_tables(spark, sf_dir, "exactly-once", fx.log_table)
    stream = cdc_log.stream_log(spark, log, max_files_per_trigger=per_batch)
    jobs.run_ingest(stream, t, checkpoint, pause_seconds=0.1, fault=jobs.fault_once("before_commit", 1))
    return _text(t.current())


@query
def stream_changelog_totals(spark, sf_dir):
    """Changelog, dead letters and ledger of a poisoned stream."""
    t, log, checkpoint, per_batch = _stream_tables(
        spark, sf_dir, "totals", lambda s, d: fx.stored(s, d, "poisoned", fx.poisoned_log)
    )
    jobs.run_ingest(cdc_log.stream_log(spark, log, max_files_per_trigger=per_batch), t, checkpoint)
    n = F.count(F.lit(1)).alias("n")
    return (
        t.changelog().agg(F.lit("changelog").alias("what"), n)
        .unionByName(t.dead_letters().agg(F.lit("dead_letters").alias("what"), n))
        .unionByName(t.current().agg(F.lit("current").alias("what"), n))
        .unionByName(t.commits().agg(F.lit("ledger_changelog").alias("what"), F.sum("changelog_rows").alias("n")))
    )


@query
def stream_redelivery(spark, sf_dir):
    """The log again in a fresh lineage; the union of lineages holds every image twice."""
    t, log, checkpoint, per_batch = _stream_tables(spark, sf_dir, "redelivery", fx.log_table)
    stream = cdc_log.stream_log(spark, log, max_files_per_trigger=per_batch)
    jobs.run_ingest(stream, t, checkpoint)
    again = t.next_epoch()
    jobs.run_ingest(stream, again, checkpoint + "-again")
    both = t.changelog().unionByName(again.changelog())
    return audits.redelivery_audit(both, state.current_state(both))


@query
def stream_compacted(spark, sf_dir):
    """Current state read through a compacted base and later batches."""
    t, log, checkpoint, per_batch = _stream_tables(spark, sf_dir, "compacted", fx.log_table)
    half = cdc_log.stream_log(spark, log, max_files_per_trigger=per_batch).where(
        F.col("timestamp_ms") < _half_time(spark, sf_dir)
    )
    jobs.run_ingest(half, t, checkpoint)
    maintenance.compact_current(t)
    rest = cdc_log.read_log(spark, log).where(F.col("timestamp_ms") >= _half_time(spark, sf_dir))
    jobs.write_batch(t, rest, t.last_batch() + 1)
    return _text(t.current())


@query
def stream_coalesce(spark, sf_dir):
    """Newest change per key after a quiet period."""
    root = scratch_dir(spark, "coalesce")
    log = fx.log_table(spark, sf_dir)
    files = _log_files(log.count())
    log.repartitionByRange(files, "timestamp_ms", "partition").write.parquet(f"{root}/log")
    images = changes(decode(cdc_log.stream_log(spark, f"{root}/log", max_files_per_trigger=_per_batch(files))))
    q = coalesce.start_coalesced(images.where(F.col("cdc_row_kind") != "-U"), 2000, f"{root}/out", f"{root}/checkpoint")
    try:
        # the wait ends with the input: it looks at progress reports, and an ended query fails it
        jobs.wait_until(lambda: coalesce.all_quiet(q), "quiet keys", 24 * 3600, query=q)
    finally:
        coalesce.stop_between_batches(q)
    return _text(
        coalesce.quiet_images(spark.read.parquet(f"{root}/out")).select(*ORDER_COLUMNS, "cdc_row_kind")
    )


from tidemark.plans import stream_queries  # noqa: E402,F401  registers its queries
