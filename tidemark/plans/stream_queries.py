"""Registered queries over streams beside the plain ingest: gate, repairs, snapshot, rebuilds."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import id_runs
from tidemark.operators import audits, contracts, diff, epochs, maintenance, measures, schema_tree, state
from tidemark.plans import fixtures as fx
from tidemark.plans.queries import RECORDS_PER_FILE, _half_time, _log_files, _per_batch, _stream_tables, _text, query
from tidemark.schemas import ORDER_COLUMNS, RUN_FIELDS
from tidemark.session import scratch_dir
from tidemark.sources import cdc_log, checkpoints, reports, runs, tables
from tidemark.sources.ledger_rules import RULES, validate_by_rules
from tidemark.streaming import dedup, gate, jobs, repairs, snapshot

SLICES = 6  # appends to a log that arrives in order of time
MOST_FILES = 2000  # of a log in files of limited rows


_made: dict[tuple[str, str, str], tables.TableSet] = {}


def _once(build: Callable[[SparkSession, str], tables.TableSet]) -> Callable[[SparkSession, str], tables.TableSet]:
    """The tables of a stream are made once per application and input; its queries read them."""

    def made(spark: SparkSession, sf_dir: str) -> tables.TableSet:
        key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
        if key not in _made:
            _made[key] = build(spark, sf_dir)
        return _made[key]

    return made


def _in_slices(slices: Iterable[DataFrame], path: str) -> int:
    """Append the log slice by slice, so that a file stream reads it in that order; files per micro-batch."""
    for records in slices:
        # as files arrive: a file's records are near each other in the source, and nothing is shuffled or staged
        records.write.option("maxRecordsPerFile", RECORDS_PER_FILE).mode("append").parquet(path)
    files = cdc_log.read_log(records.sparkSession, path).select(F.input_file_name()).distinct().count()
    return _per_batch(files, SLICES)  # a gated batch reads what is known of its keys, so few and large ones


@_once
def _gated(spark: SparkSession, sf_dir: str) -> tables.TableSet:
    """The ordering probe through the gated ingest, with a failure before a commit."""
    root = scratch_dir(spark, "gate")
    probe = fx.ordering_probe(spark, sf_dir)
    per_batch = _in_slices((probe.where(F.col("timestamp_ms") == fx.BASE_MS + i) for i in range(3)), f"{root}/log")
    t = tables.TableSet(spark, f"{root}/tables").ensure()
    stream = cdc_log.stream_log(spark, f"{root}/log", max_files_per_trigger=per_batch)
    fault = jobs.fault_once("before_commit", 1)
    jobs.run_ingest(stream, t, f"{root}/checkpoint", pause_seconds=0.1, fault=fault, gated=True)
    return t


@query
def stream_gate(spark, sf_dir):
    """Current rows behind the gate: no mis-keyed order is among them."""
    return _text(gate.admitted_current(_gated(spark, sf_dir)))


@query
def stream_gate_audit(spark, sf_dir):
    """What the gate learned batch by batch, in the columns of the audit over the whole probe."""
    return gate.gate_audit(gate.high_water(_gated(spark, sf_dir)))


@query
def stream_gate_isolated(spark, sf_dir):
    """Records kept apart, per partition."""
    apart = _gated(spark, sf_dir).committed("isolated")
    return apart.groupBy("partition").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("order_id").alias("orders"), F.max("offset").alias("last_offset")
    )


@_once
def _repaired(spark: SparkSession, sf_dir: str) -> tables.TableSet:
    """The poisoned log, its own repairs, an operator's, and a run that finds nothing left to do."""
    stored = fx.stored(spark, sf_dir, "twice-poisoned", fx.twice_poisoned_log)
    t, log, checkpoint, per_batch = _stream_tables(spark, sf_dir, "repair", lambda s, d: stored)
    jobs.run_ingest(cdc_log.stream_log(spark, log, max_files_per_trigger=per_batch), t, checkpoint)
    repairs.commit_repairs(t)
    repairs.commit_repairs(t, fx.operator_documents(spark, sf_dir))
    repairs.commit_repairs(t)
    return t


@query
def stream_repair(spark, sf_dir):
    return _text(_repaired(spark, sf_dir).current())


@query
def stream_repair_states(spark, sf_dir):
    return repairs.letter_states(_repaired(spark, sf_dir)).drop("topic")


@_once
def _handed_over(spark: SparkSession, sf_dir: str) -> tables.TableSet:
    """A snapshot taken while the log goes on, broken off after its second chunk and resumed.

    The stream starts in the middle of the log. The first chunks see the source as it was then;
    the rest of the log arrives after them, and later chunks see what it left.
    """
    root = scratch_dir(spark, "snapshot")
    half = _half_time(spark, sf_dir)
    log, images = fx.log_table(spark, sf_dir), fx.changelog_table(spark, sf_dir)
    files = _log_files(log.count())
    now = [half]

    def append(rows: DataFrame) -> None:
        rows.repartitionByRange(files, "timestamp_ms", "partition").write.mode("append").parquet(f"{root}/log")

    def ingest() -> None:
        stream = cdc_log.stream_log(spark, f"{root}/log", "timestamp", f"{root}/starts", half, _per_batch(files))
        jobs.run_ingest(stream, t, f"{root}/checkpoint")

    def source() -> DataFrame:
        return state.current_state(images.where(F.col("timestamp_ms") <= F.lit(now[0])))

    def after_chunk(chunk: int) -> None:
        if chunk == 1:
            append(log.where(F.col("timestamp_ms") > half))
            now[0] = 1 << 62
            raise RuntimeError("broken off")

    t = tables.TableSet(spark, f"{root}/tables").ensure()
    append(log.where(F.col("timestamp_ms") <= half))
    ingest()
    chunk_rows = max(1, fx.orders(spark, sf_dir).count() // 6)
    try:
        snapshot.run_snapshot(t, source, f"{root}/log", fx.TOPIC, half, chunk_rows, after_chunk)
    except RuntimeError:
        ingest()
    snapshot.run_snapshot(t, source, f"{root}/log", fx.TOPIC, half, chunk_rows)
    return t


@query
def stream_snapshot(spark, sf_dir):
    return _text(_handed_over(spark, sf_dir).current())


@query
def stream_snapshot_hand_over(spark, sf_dir):
    row = snapshot.hand_over(_handed_over(spark, sf_dir))
    return row.select((F.col("committed_chunks") >= 3).alias("several_chunks"), "past_marks", "complete")


@query
def stream_linkage(spark, sf_dir):
    """Offsets, checkpoint and snapshots of a run over a log that ends in tombstones."""

    def with_tombstones(s: SparkSession, d: str) -> DataFrame:
        log = fx.log_table(s, d)
        ends = log.groupBy("topic", "partition").agg(F.max("offset").alias("o"), F.max("timestamp_ms").alias("t"))
        tail = ends.select(
            "topic", "partition", (F.col("o") + 1).alias("offset"), (F.col("t") + 1).alias("timestamp_ms"),
            F.lit(b"gone").alias("key"), F.lit(None).cast("binary").alias("value"),
        )
        return log.unionByName(tail)

    t, log, checkpoint, per_batch = _stream_tables(spark, sf_dir, "linkage", with_tombstones)
    jobs.run_ingest(cdc_log.stream_log(spark, log, max_files_per_trigger=per_batch), t, checkpoint)
    row = checkpoints.stream_linkage(t, checkpoint, cdc_log.read_log(spark, log), "run")
    return row.select(
        "run_id",
        "partitions",
        "lag_zero",
        (F.col("checkpoint_id") == F.col("ledger_batch_id")).alias("checkpoint_is_commit"),
        ((F.col("current_snapshot_id") <= F.col("checkpoint_id")) & (F.col("changelog_snapshot_id") <= F.col("checkpoint_id"))).alias(
            "snapshots_are_older"
        ),
        "complete",
    )


@query
def stream_dedup(spark, sf_dir):
    """Images of a log of which every record is delivered again one slice of time later."""
    root = scratch_dir(spark, "dedup")
    log = fx.log_table(spark, sf_dir)
    ends = log.agg(F.min("timestamp_ms").alias("a"), F.max("timestamp_ms").alias("b")).first()
    span = (ends.b - ends.a) // SLICES + 1
    at = F.col("timestamp_ms")

    def slice_(n: int) -> DataFrame:
        """The records of one slice of time, if there is one, and those of the slice before again."""
        first = [log.where(at.between(ends.a + i * span, ends.a + (i + 1) * span - 1)) for i in (n - 1, n) if 0 <= i < SLICES]
        return reduce(DataFrame.unionAll, first)

    per_batch = _in_slices((slice_(n) for n in range(SLICES + 1)), f"{root}/log")
    stream = cdc_log.stream_log(spark, f"{root}/log", max_files_per_trigger=per_batch)
    t = tables.TableSet(spark, f"{root}/tables").ensure()
    jobs.run_ingest(dedup.drop_redelivered(stream, f"{3 * span} milliseconds"), t, f"{root}/checkpoint")
    return t.changelog().groupBy("partition", "cdc_row_kind").agg(
        F.count(F.lit(1)).alias("images"), F.count_distinct("offset").alias("records")
    )


@query
def rebuild_audit(spark, sf_dir):
    """Two rebuilds of one lineage: from a timestamp, where orders untouched since are missing, and from 0."""
    t, log, checkpoint, per_batch = _stream_tables(spark, sf_dir, "rebuild", fx.log_table)
    jobs.run_ingest(cdc_log.stream_log(spark, log, max_files_per_trigger=per_batch), t, checkpoint)
    half = _half_time(spark, sf_dir)
    later, full = t.next_epoch(), t.next_epoch().next_epoch()
    stream = cdc_log.stream_log(spark, log, "timestamp", f"{checkpoint}-starts", half, per_batch)
    jobs.run_ingest(stream, later, f"{checkpoint}-later")
    jobs.run_ingest(cdc_log.stream_log(spark, log, max_files_per_trigger=per_batch), full, f"{checkpoint}-full")
    starts = spark.read.parquet(f"{checkpoint}-starts")
    zero = cdc_log.offsets_for_timestamp(cdc_log.read_log(spark, log), 0)
    rows = [
        epochs.rebuild_audit(t, target, "order_id", ORDER_COLUMNS, begun).select(
            F.lit(name).alias("rebuild"),
            (F.col("differing_buckets") > 0).alias("differs"),
            "missing_keys",
            "unexpected_keys",
            "changed_keys",
            "lineages",
            "resolved_after_zero",
            "matches",
        )
        for name, target, begun in (("timestamp", later, starts), ("offset 0", full, zero))
    ]
    return rows[0].unionByName(rows[1])


@query
def schema_tree_evolution(spark, sf_dir):
    """What the second version of each nested contract changes, by path."""
    return schema_tree.evaluate_tree(schema_tree.schema_nodes(fx.nested_registry(spark, sf_dir)), 1, 2)


@query
def schema_tree_fields(spark, sf_dir):
    """Fields of the nested contracts: where they stand, what may be in them, and what is wrong."""
    nodes = schema_tree.schema_nodes(fx.nested_registry(spark, sf_dir))
    types = F.array_join(F.array_sort(F.collect_set(F.when(F.col("node") == "type", F.col("key")))), ",")
    return nodes.groupBy("subject", "version", "path").agg(
        types.alias("types"),
        F.max("position").alias("position"),
        F.coalesce(F.max(F.when(F.col("node") == "field", F.col("has_default"))), F.lit(False)).alias("has_default"),
        F.max("problem").alias("problem"),
    )


@query
def ledger_rules(spark, sf_dir):
    """Rules of six kinds of records that the records break."""
    return validate_by_rules(fx.kind_records(spark, sf_dir), RULES)


@query
def event_id_expectations(spark, sf_dir):
    """Visible ids and their changelog against the id ranges of the workload's commit batches."""
    events, visible = fx.table(spark, sf_dir, "events"), fx.visible_events(spark, sf_dir)
    batches = fx.event_batches(spark, sf_dir).select(F.col("first_event_id").alias("first"), F.col("last_event_id").alias("last"))
    repeated = events.agg((F.count(F.lit(1)) + F.count_if(F.col("event_id") % 2 == 0)).alias("n"))
    return audits.expected_event_ids(events, visible, visible, batches, batches, repeated)


@query
def visible_in_workload(spark, sf_dir):
    """First visible events per snapshot, cut to the ids of the workload; strays are left out."""
    visible = fx.visible_events(spark, sf_dir)
    strays = visible.withColumn("event_id", F.col("event_id") + 1_000_000_000)
    batches = fx.event_batches(spark, sf_dir)
    runs = id_runs.cut_runs(batches, "first_event_id", "last_event_id")
    kept = id_runs.within_runs(visible.unionByName(strays), "event_id", runs)
    return kept.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("events"), F.max("event_id").alias("last_event_id"))


@query
def observed_metric_names(spark, sf_dir):
    """Names of the connector's metrics and of the lag metrics among all samples."""
    name = F.lower("name")
    families = {"connector_metric_names": name.startswith("debezium_"), "lag_metric_names": F.contains(name, F.lit("records_lag"))}
    return measures.observed_metric_names(reports.parse_metrics(fx.metric_lines(spark, sf_dir)), families)


@query
def current_in_key_order(spark, sf_dir):
    """The current rows as a sorted result; the order is the feature."""
    return _text(state.current_state(fx.changelog_table(spark, sf_dir))).orderBy("order_id")


@query
def rows_conform(spark, sf_dir):
    """Raw order rows that can be read as the contract's columns, per status."""
    required = [("o_orderkey", "bigint"), ("o_custkey", "int"), ("o_orderpriority", "int")]
    rows = fx.table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.substring("o_orderpriority", 1, 1))
    broken = rows.withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 == 0, "none").otherwise(F.col("o_custkey").cast("string")))
    return broken.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(contracts.conforms(broken, required)).alias("conforming")
    )


def _row_limit(records: int) -> int:
    """Rows of a file: 1000 up to two million records, beyond that files grow and not their number."""
    return max(1000, records // MOST_FILES)


@query
def stored_files(spark, sf_dir):
    """Files of a compacted stream: within the row limit, listed as the tables read them."""
    root = scratch_dir(spark, "files")
    log = fx.log_table(spark, sf_dir)
    limit = _row_limit(log.count())
    t = tables.TableSet(spark, root, file_rows=limit, row_group_bytes=1 << 20).ensure()
    jobs.write_batch(t, log, 0)
    maintenance.compact_current(t)
    stats = maintenance.table_files(t, ["current", "changelog", "base"])
    per_file = None
    for name in ("current", "changelog", "base"):
        rows = t.scan(name).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n"))
        part = rows.agg(F.lit(name).alias("dataset"), F.max("n").alias("most"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("read"))
        per_file = part if per_file is None else per_file.unionAll(part)
    return stats.join(per_file, "dataset").select(
        "dataset",
        "rows",
        (F.col("most") <= limit).alias("within_limit"),
        (F.col("data_file_count") >= F.col("read")).alias("all_listed"),
        F.col("manifest_count").alias("folders"),
    )


@query
def stream_savepoint(spark, sf_dir):
    """A stream stopped in the middle of the log and resumed from a copy of its checkpoint."""
    root = scratch_dir(spark, "savepoint")
    log, half = fx.log_table(spark, sf_dir), _half_time(spark, sf_dir)
    t = tables.TableSet(spark, f"{root}/tables").ensure()
    files = _log_files(log.count() // 2)
    for early in (True, False):
        part = log.where(F.col("timestamp_ms") <= half if early else F.col("timestamp_ms") > half)
        part.repartitionByRange(files, "timestamp_ms", "partition").write.mode("append").parquet(f"{root}/log")
        stream = cdc_log.stream_log(spark, f"{root}/log", max_files_per_trigger=_per_batch(files))
        jobs.run_ingest(stream, t, f"{root}/checkpoint" if early else f"{root}/copy")
        if early:
            jobs.savepoint(t, f"{root}/checkpoint", f"{root}/copy")
    return _text(t.current())


@query
def written_run_record(spark, sf_dir):
    """A reconciliation written as a run record, read back from the ledger and checked."""
    source = fx.source_orders(spark, sf_dir)
    result = diff.reconcile(source, state.current_state(fx.changelog_table(spark, sf_dir)), ORDER_COLUMNS).first()
    path = scratch_dir(spark, "ledger")
    provenance = {f: "x" for f in RUN_FIELDS} | {"run_id": "run-1", "stack_versions": {"spark": spark.version}}
    payload = {"phase": "B3", "failure_class": "offset-replay", "snapshot_diff_count": result.diff_count, "rows": result.actual_rows}
    runs.write_run_record(spark, f"{path}/record-1", provenance, payload)
    ledger = runs.read_run_ledger(spark, path)
    doc = F.from_json("document", "rows BIGINT, snapshot_diff_count BIGINT")
    broken = runs.validate_ledger(ledger).groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("broken"))
    return ledger.select("name", doc.alias("d")).join(broken, "name", "left").select("name", "d.*", "broken")
