"""Change logs and measurements derived from the driver's tables.

Every derivation covers its whole input table, so the work grows with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import blocked
from tidemark.functions.columns import floor_div, with_wire_header
from tidemark.operators.decode import changes, decode, valid_records
from tidemark.operators.encode import (
    envelope,
    epoch_millis_variant,
    null_row,
    number_variant,
    wire_row,
)
from tidemark.operators.offsets import log_end_offsets
from tidemark.schemas import ORDER_COLUMNS, REPAIR_FORMAT
from tidemark.session import scratch_dir
from tidemark.sources.runs import DRILLS
from tidemark.sources.workload import commit_batches

TOPIC = "shop.orders"
PARTITIONS = 3
BASE_MS = 1_767_225_600_000
BLOCK = 65_536
SEED = 17
SPREAD_ROWS = 25_000  # narrow rows a task turns into documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to tasks of about ``SPREAD_ROWS`` by ranges of the key.

    A file of narrow rows is read by few tasks, however much is derived from each row.
    """
    return rows.repartitionByRange(1 + rows.count() // SPREAD_ROWS, key)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k")


def _row(event: Column, status: Column, cents: Column, ts: Column) -> Column:
    """A row image of order ``k``."""
    k = F.col("k")
    values = {
        "order_id": k,
        "business_key": F.concat(F.lit("order-"), F.lpad(k.cast("string"), 12, "0")),
        "event_id": event,
        "customer_id": F.col("o_custkey"),
        "status": status,
        "amount_cents": cents,
        "updated_at": ts,
        "seed": F.lit(SEED),
    }
    return F.struct(*[values[c].alias(c) for c in ORDER_COLUMNS])


def _image(version: Column) -> Column:
    """The order as created (version 1) or after its update (version 2); null otherwise."""
    second = version == 2
    created = (
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "created")
        .otherwise("paid")
    )
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    row = _row(
        F.col("k") * 10 + version,
        F.when(second, "shipped").otherwise(created),
        cents + F.when(second, 7).otherwise(0),
        F.col("o_orderdate") + F.when(second, F.expr("INTERVAL '1' DAY")).otherwise(
            F.expr("INTERVAL '0' DAY")
        ),
    )
    return F.when(version.isNotNull(), row)


def order_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 before encoding: k, seq, op, before, after, partition, offset.

    Each order is created or snapshotted (seq 1), every second one updated
    (seq 2), every fifth one deleted (seq 3). Offsets are dense per partition in
    (seq, k) order; a partition holds a third of all records, so they are
    numbered in blocks, before the row images are built.
    """
    k = F.col("k")
    updated, deleted = k % 2 == 0, k % 5 == 0
    seqs = (
        F.when(updated & deleted, F.array(F.lit(1), F.lit(2), F.lit(3)))
        .when(updated, F.array(F.lit(1), F.lit(2)))
        .when(deleted, F.array(F.lit(1), F.lit(3)))
        .otherwise(F.array(F.lit(1)))
    )
    steps = (
        orders(spark, sf_dir)
        .withColumn("seq", F.explode(seqs))
        .withColumn("partition", (k % PARTITIONS).cast("int"))
    )
    numbered = blocked.row_number(
        steps,
        ["partition"],
        ["seq", "k"],
        F.struct(F.col("seq"), floor_div(k, BLOCK)),
        "n",
    )
    seq = F.col("seq")
    return numbered.select(
        "k",
        "seq",
        F.when(seq == 2, "u").when(seq == 3, "d").when(k % 10 == 0, "r").otherwise("c").alias("op"),
        _image(F.when(seq == 2, 1).when(seq == 3, F.when(updated, 2).otherwise(1))).alias("before"),
        _image(F.when(seq < 3, seq)).alias("after"),
        "partition",
        (F.col("n") - 1).alias("offset"),
    )


def _wire_ts(side: str) -> Column:
    """``updated_at`` in one of the four accepted wire forms, by order key."""
    ts = F.col(f"{side}.updated_at")
    form = F.pmod(F.col("k"), F.lit(4))
    text = F.when(form == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    )
    return (
        F.when(form == 0, epoch_millis_variant(ts))
        .when(form == 1, number_variant(F.unix_micros(ts.cast("timestamp"))))
        .otherwise(F.try_parse_json(F.concat(F.lit('"'), text, F.lit('"'))))
    )


def cdc_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the change log of ``orders`` as broker records."""
    return _records(order_operations(spark, sf_dir), _envelope_value())


def _ts_ms() -> Column:
    return F.lit(BASE_MS) + F.col("offset") * 1000


def _envelope_value() -> Column:
    def side(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), wire_row(f"{name}.", _wire_ts(name))).otherwise(
            null_row()
        )

    return envelope(F.col("op"), side("before"), side("after"), _ts_ms())


def _records(ops: DataFrame, value: Column) -> DataFrame:
    return ops.select(
        F.lit(TOPIC).alias("topic"),
        "partition",
        "offset",
        _ts_ms().alias("timestamp_ms"),
        F.col("k").cast("string").cast("binary").alias("key"),
        value.alias("value"),
    )


def source_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1': the source of truth, straight from ``orders``."""
    k = F.col("k")
    return (
        orders(spark, sf_dir)
        .where(k % 5 != 0)
        .select(_image(F.when(k % 2 == 0, 2).otherwise(1)).alias("r"))
        .select("r.*")
    )


def redelivered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every record delivered twice."""
    return cdc_log(spark, sf_dir).withColumn(
        "epoch", F.explode(F.array(F.lit(1), F.lit(2)))
    )


def poisoned_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """some creations arrive as a repair document instead of an envelope."""
    poisoned = (F.col("k") % 97 == 13) & (F.col("seq") == 1)
    document = F.to_json(
        F.struct(
            F.lit(REPAIR_FORMAT).alias("repair_format"),
            wire_row("after.").alias("intended_after"),
            F.col("op").alias("intended_operation"),
        )
    ).cast("binary")
    return _records(
        order_operations(spark, sf_dir), F.when(poisoned, document).otherwise(_envelope_value())
    )


def ordering_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """three creations per order; odd orders are keyed wrongly and arrive out of order.

    Arrival i=0,1,2 carries event 10k+1, +2, +3 (even orders, key k, one
    partition) or 10k+1, +3, +2 (odd orders, keys k+100+i, partition i).
    """
    k, i = F.col("k"), F.col("i")
    miskeyed = k % 2 == 1
    step = F.when(miskeyed & (i > 0), 4 - i).otherwise(i + 1)
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return (
        spread(orders(spark, sf_dir).select("k", "o_custkey", "o_totalprice", "o_orderdate"), "k")
        .withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .select(
            F.lit("shop.orders.probe").alias("topic"),
            F.when(miskeyed, i).otherwise(k % PARTITIONS).cast("int").alias("partition"),
            (k * 3 + i).alias("offset"),
            (F.lit(BASE_MS) + i).cast("bigint").alias("timestamp_ms"),
            F.when(miskeyed, k + 100 + i).otherwise(k).cast("string").cast("binary").alias("key"),
            _row(k * 10 + step, F.lit("paid"), cents, F.col("o_orderdate")).alias("after"),
        )
        .select(
            "topic",
            "partition",
            "offset",
            "timestamp_ms",
            "key",
            envelope(
                F.lit("c"), null_row(), wire_row("after."), F.col("timestamp_ms")
            ).alias("value"),
        )
    )


# -- stored derivations ---------------------------------------------------------

_stored: dict[tuple[str, str, str], str] = {}


def stored(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]
) -> DataFrame:
    """A derivation as a Parquet table in the shared folder, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = scratch_dir(spark, name)
        build(spark, sf_dir).write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "log", cdc_log)


def changelog_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 decoded: every image with its log position."""
    return stored(spark, sf_dir, "changelog", lambda s, d: changes(decode(log_table(s, d))))


def probe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 decoded, with the key the record was sent under."""

    def build(s: SparkSession, d: str) -> DataFrame:
        outcomes = valid_records(decode(ordering_probe(s, d)))
        return outcomes.select(
            F.col("key").cast("string").cast("bigint").alias("key_order_id"),
            "image.row.order_id",
            "image.row.event_id",
            "partition",
            "offset",
            "timestamp_ms",
        )

    return stored(spark, sf_dir, "probe", build)


# -- measurements ---------------------------------------------------------------


def end_offsets(log: DataFrame) -> DataFrame:
    """log ends, plus one partition that never got a record."""
    ends = log_end_offsets(log).select("partition", "log_end_offset")
    return ends.unionByName(
        ends.agg((F.max("partition") + 1).alias("partition"), F.lit(0).cast("bigint").alias("log_end_offset"))
    )


def group_offsets(log: DataFrame) -> DataFrame:
    """the committed offsets, ten per partition number behind the end."""
    return log_end_offsets(log).select(
        "partition",
        (F.col("log_end_offset") - F.col("partition") * 10).alias("current_offset"),
        "log_end_offset",
    )


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn(
        "epoch_ms", F.unix_millis(F.col("ts").cast("timestamp"))
    )


def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit batches of 100 events."""
    return commit_batches(timed_events(spark, sf_dir), 100, "event_id", "epoch_ms", "epoch_ms")


def event_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one snapshot per 500 events."""
    s = floor_div(F.col("event_id"), 500) + 1
    return (
        timed_events(spark, sf_dir)
        .groupBy(s.alias("snapshot_id"))
        .agg(F.max("epoch_ms").alias("ms"))
        .select(
            "snapshot_id",
            (F.col("ms") + 5000 + F.col("snapshot_id")).alias("committed_at_epoch_ms"),
        )
    )


def visible_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events per snapshot; even ones are delivered again in the next snapshot."""
    s = floor_div(F.col("event_id"), 500) + 1
    again = F.when(F.col("event_id") % 2 == 0, F.array(s, s + 1)).otherwise(F.array(s))
    return table(spark, sf_dir, "events").select("event_id", F.explode(again).alias("snapshot_id"))


def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exposition text, one metric line per event and a comment before every tenth."""
    kind = F.col("event_type")
    job = F.concat(F.lit('{job_id="'), F.col("user_id") % 3, F.lit('",task="t'), F.col("user_id") % 7, F.lit('"} '))
    turn = F.col("event_id") % 6
    name = (
        F.when(turn == 0, F.concat(F.lit("job_"), kind, F.lit("_busyTimeMsPerSecond")))
        .when(turn == 1, F.concat(F.lit("job_"), kind, F.lit("_backPressuredTimeMsPerSecond")))
        .when(turn == 2, F.concat(F.lit("job_"), kind, F.lit("_checkpointAlignmentTime")))
        .when(turn == 3, F.concat(F.lit("source_"), kind, F.lit("_records_lag_max")))
        .when(turn == 4, F.concat(F.lit("source_"), kind, F.lit("_committedOffsets")))
        .otherwise(F.concat(F.lit("debezium_"), kind, F.lit("_TotalNumberOfEventsSeen")))
    )
    line = F.concat(name, job, F.col("value").cast("string"))
    lines = F.when(
        F.col("event_id") % 10 == 0, F.array(F.concat(F.lit("# HELP "), name), F.lit(""), line)
    ).otherwise(F.array(line))
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("scrape"), F.explode(lines).alias("value")
    )


def load_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one sample per event type and day; three baseline samples come first."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("series"), F.date_trunc("day", "ts").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("value").alias("duration_ms"),
            F.min("value").alias("alignment_ms"),
            F.max(F.col("value") / 1000).alias("indicator"),
            F.count_if(F.col("value") > 100).alias("failed_count"),
        )
        .select(
            "series",
            F.date_diff("day", F.lit("2024-01-01")).cast("bigint").alias("sample_index"),
            F.greatest(F.col("n") - 67, F.lit(0)).alias("lag_events"),
            "duration_ms",
            "alignment_ms",
            "indicator",
            "failed_count",
        )
    )


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: documents stand in for files, their source for the manifest."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("path"),
        F.col("n_chars").alias("size_bytes"),
        F.col("source").alias("manifest"),
    )


def schema_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one subject per part, two versions each; the part number decides what changes."""
    p = F.col("p_partkey")

    def field(name: str, type_: Column, default: str = "") -> Column:
        return F.concat(F.lit(f'{{"name":"{name}","type":'), type_, F.lit(f"{default}}}"))

    def record(*fields: Column) -> Column:
        return F.concat(
            F.lit('{"type":"record","name":"Part","fields":['), F.concat_ws(",", *fields), F.lit("]}")
        )

    key = field("p_partkey", F.lit('"long"'))
    size = field("p_size", F.lit('"int"'))
    stamp = field("updated_at", F.lit('{"type":"long","logicalType":"timestamp-micros"}'))
    stamp2 = field("updated_at", F.lit('{"logicalType":"timestamp-micros","type":"long"}'))
    first = record(key, size, stamp)
    case = p % 6
    second = (
        F.when(case == 0, record(key, size, stamp2))
        .when(case == 1, record(key, size, stamp, field("brand", F.lit('["null","string"]'), ',"default":null')))
        .when(case == 2, record(key, stamp))
        .when(case == 3, record(key, field("p_size", F.lit('"string"')), stamp))
        .when(case == 4, record(key, size, stamp, field("brand", F.lit('"string"'))))
        .otherwise(record(key, field("p_size", F.lit('"long"')), stamp))
    )
    return spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(
        F.concat(F.lit("part-"), p.cast("string")).alias("subject"),
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("version"), first.alias("schema_json")),
                F.struct(F.lit(2).alias("version"), second.alias("schema_json")),
            )
        ),
    )


def wire_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payloads with a wire header per order; every eleventh lacks it."""
    k = F.col("k")
    payload = F.col("o_orderpriority").cast("binary")
    return orders(spark, sf_dir).select(
        F.when(k % 11 == 0, payload).otherwise(with_wire_header(k % 7 + 100, payload)).alias("value")
    )


def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one drill record per customer; the customer number decides which rules it breaks."""
    c = F.col("c_custkey")
    drill = F.element_at(F.array(*[F.lit(d) for d in DRILLS]), (c % 5 + 1).cast("int"))
    run_id = F.when(c % 17 != 0, F.concat(F.lit("run-"), c.cast("string")))
    doc = F.struct(
        F.lit("B3").alias("phase"),
        drill.alias("failure_class"),
        run_id.alias("run_id"),
        F.lit("0" * 8).alias("git_sha"),
        F.lit("2026-01-01T00:00:00Z").alias("started_at"),
        F.lit("2026-01-01T00:01:00Z").alias("finished_at"),
        F.struct(F.lit("4.1.2").alias("spark")).alias("stack_versions"),
        F.lit("verify").alias("command"),
        F.concat(F.lit("logs/"), (c % 10).cast("string"), F.lit(".log")).alias("logs"),
        F.when(c % 13 == 0, 1).otherwise(0).alias("snapshot_diff_count"),
        F.struct(F.lit(8).alias("cpus")).alias("environment"),
        F.struct((c % 19 != 0).alias("rows_match"), F.lit(True).alias("digest_match")).alias("checks"),
        F.struct((c % 19 != 0).alias("passed")).alias("summary"),
        F.struct(
            F.array(F.struct(F.lit(0).alias("partition"), F.when(c % 23 == 0, 5).otherwise(0).alias("lag"))).alias(
                "kafka_offsets"
            ),
            F.struct(c.alias("id")).alias("checkpoint"),
            F.struct(c.alias("orders_current"), (c + 1).alias("orders_changelog")).alias("snapshot_ids"),
        ).alias("offset_checkpoint_snapshot_linkage"),
        F.struct(F.lit(36).alias("occurrences"), F.when(c % 29 == 0, 35).otherwise(36).alias("expected")).alias(
            "duplicates"
        ),
        F.struct(F.lit(1).alias("violations"), (c % 31 != 0).alias("would_corrupt")).alias("miskey"),
        F.when(c % 37 == 0, 2).otherwise(1).alias("dead_letters"),
    )
    return spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(
        F.concat(F.lit("record-"), c.cast("string")).alias("name"), F.to_json(doc).alias("document")
    )


def drill_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run results per order: class, seconds, diff, audit and error."""
    k = F.col("k")
    return orders(spark, sf_dir).select(
        F.element_at(F.array(*[F.lit(d) for d in DRILLS]), (k % 5 + 1).cast("int")).alias("failure_class"),
        (F.col("o_custkey") % 60 + 1).cast("double").alias("recovery_seconds"),
        F.when(k % 101 == 0, 1).otherwise(0).cast("bigint").alias("snapshot_diff_count"),
        (k % 103 != 0).alias("audit_consistent"),
        (k % 107 != 0).alias("passed"),
        F.when(k % 107 == 0, F.concat(F.lit("run "), k.cast("string"), F.lit(" failed"))).alias("error"),
    )


def odd_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one value per order in each accepted and rejected form a decoder meets."""
    k = F.col("k")

    def doc(order_id: Column, status: str, ts: str, op: str = "c", ts_ms: str = "1", tail: str = "}") -> Column:
        return F.concat(
            F.lit('{"before":null,"after":{"order_id":'),
            order_id,
            F.lit(
                f',"business_key":"b","event_id":1,"customer_id":2,"status":{status},'
                f'"amount_cents":3,"updated_at":{ts},"seed":4,"extra":{{"x":1}}}},"op":"{op}","ts_ms":{ts_ms}{tail}'
            ),
        )

    n = k.cast("string")
    quoted = F.concat(F.lit('"'), n, F.lit('"'))
    forms = [
        doc(n, '"paid"', "1767225600123"),
        doc(F.concat(n, F.lit(".75")), '"paid"', "1767225600123456"),
        doc(quoted, '"paid"', "1767225600123"),
        doc(n, "5", "1767225600123"),
        doc(n, '"5"', '"2026-01-01 00:00:00"'),
        doc(n, '"paid"', '"2026-01-01T00:00:00.123456Z"'),
        doc(n, '"paid"', "true"),
        doc(n, '"paid"', "1767225600123", op="x"),
        doc(n, '"paid"', "1767225600123", ts_ms='"late"'),
        doc(n, '"paid"', "1767225600123", tail=""),
        doc(n, '"paid"', "1767225600123", op="u"),
        F.lit(None).cast("string"),
    ]
    value = F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int"))
    return orders(spark, sf_dir).select(
        F.lit(TOPIC).alias("topic"),
        F.lit(0).alias("partition"),
        k.alias("offset"),
        F.lit(BASE_MS).cast("bigint").alias("timestamp_ms"),
        n.cast("binary").alias("key"),
        value.cast("binary").alias("value"),
    )


# -- repairs --------------------------------------------------------------------


def _lost() -> Column:
    """Creations that arrive as bytes no decoder reads."""
    return (F.col("seq") == 1) & (F.col("k") % 101 == 7)


def _misrepaired() -> Column:
    """Creations whose repair document names an operation that does not exist."""
    return (F.col("seq") == 1) & (F.col("k") % 97 == 13) & (F.col("k") % 5 == 3) & ~_lost()


def _document(op: Column) -> Column:
    parts = F.struct(
        F.lit(REPAIR_FORMAT).alias("repair_format"), wire_row("after.").alias("intended_after"), op.alias("intended_operation")
    )
    return F.to_json(parts).cast("binary")


def twice_poisoned_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 with repair documents that fail again and with records nobody can repair."""
    poisoned = (F.col("k") % 97 == 13) & (F.col("seq") == 1)
    value = (
        F.when(_lost(), F.lit("no document").cast("binary"))
        .when(_misrepaired(), _document(F.lit("x")))
        .when(poisoned, _document(F.col("op")))
        .otherwise(_envelope_value())
    )
    return _records(order_operations(spark, sf_dir), value)


def operator_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what an operator hands in later for the failed repairs of odd orders."""
    wanted = order_operations(spark, sf_dir).where(_misrepaired() & (F.col("k") % 2 == 1))
    return wanted.select(F.lit(TOPIC).alias("topic"), "partition", "offset", _document(F.col("op")).alias("document"))


# -- records of every kind --------------------------------------------------------

RECORD_KINDS = ["parity", "schema-contract", "small-file-rewrite", "broker-restart", "offset-replay", "slo"]


def kind_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one record per customer with the fields of all kinds; its number decides what is wrong.

    Every 41st document is cut off, every 43rd has a kind without rules.
    """
    c = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in RECORD_KINDS]), (c % 6 + 1).cast("int"))

    def unless(n: int, right: object, wrong: object) -> Column:
        return F.when(c % n == 0, F.lit(wrong)).otherwise(F.lit(right))

    contract = F.struct(
        F.lit("BACKWARD").alias("compatibility"), c.alias("id"), F.lit(1).alias("version"), F.struct(F.lit("record").alias("type")).alias("schema")
    )
    lags = F.array(F.struct(F.lit(0).alias("partition"), F.lit(0).alias("lag")), F.struct(F.lit(1).alias("partition"), unless(7, 0, 3).alias("lag")))
    recovery = [
        F.struct(
            F.lit(name).alias("failure_class"), unless(29, 1.5, 0.0).alias("recovery_seconds"), F.lit(0).alias("snapshot_diff_count"),
            F.struct(F.lit(True).alias("recovered")).alias("checks"),
        )
        for name in DRILLS
    ]
    document = F.struct(
        F.when(kind == "slo", "B4").otherwise("B3").alias("phase"),
        kind.alias("failure_class"),
        F.when(c % 11 != 0, F.struct(F.lit(8).alias("cpus"))).alias("environment"),
        F.struct(unless(13, 0, 2).alias("row_level_diff_count")).alias("parity"),
        unless(13, 0, 2).alias("snapshot_diff_count"),
        F.struct(F.lit(0).alias("snapshot_diff_count")).alias("reconciliation"),
        F.struct(
            unless(17, True, False).alias("passed"), F.lit(True).alias("old_schema_pipeline_continued"), F.lit(True).alias("pipeline_resumed"),
            F.lit(0).alias("offset_zero_diff_count"), unless(23, 0, 1).alias("timestamp_diff_count"),
        ).alias("summary"),
        F.struct(
            *(F.lit(True).alias(n) for n in ("data_file_count_decreased", "manifest_count_decreased", "median_file_size_increased")),
            unless(19, True, False).alias("planning_latency_decreased"),
        ).alias("checks"),
        *(F.struct(c.alias("n")).alias(n) for n in ("before", "after", "rewrite_data_files")),
        F.struct(
            lags.alias("kafka_offsets"), F.struct(c.alias("id")).alias("flink_checkpoint"),
            F.struct(c.alias("orders_current"), c.alias("orders_changelog")).alias("iceberg_snapshot_ids"),
        ).alias("offset_checkpoint_snapshot_linkage"),
        F.struct(
            F.lit("AVRO").alias("format"), F.lit("BACKWARD").alias("global_compatibility"), contract.alias("key"), contract.alias("value")
        ).alias("contracts"),
        F.struct(
            F.struct(F.lit(False).alias("is_compatible")).alias("compatibility_check"),
            F.struct(unless(31, 409, 200).alias("http_status"), F.lit(True).alias("rejected")).alias("registration"),
            F.lit(True).alias("latest_schema_unchanged"),
        ).alias("incompatible_schema_attempt"),
        F.struct(
            F.struct(
                F.lit(0).alias("source_iceberg_diff_count"), F.lit(True).alias("post_event_visible"),
                F.struct(c.alias("id")).alias("flink_checkpoint"), lags.alias("kafka_offsets"),
            ).alias("after_rejection")
        ).alias("flow_continuity"),
        F.struct(
            F.struct(F.lit(False).alias("Running")).alias("container_killed"), F.struct(unless(23, True, False).alias("Running")).alias("container_after")
        ).alias("fault"),
        F.struct(F.array(c).alias("resolved_partition_offsets")).alias("timestamp_replay"),
        F.struct(F.lit(100_000).alias("events"), F.lit(42).alias("seed")).alias("scenario"),
        F.struct(
            F.array(F.struct(c.alias("at")), F.struct(c.alias("at"))).alias("time_series"),
            F.struct(
                *(F.lit(3).alias(n) for n in ("lag_sample_count", "prometheus_lag_sample_count", "debezium_sample_count", "max_consumer_group_lag")),
                F.array(F.lit("a"), F.lit("b")).alias("debezium_metric_names"),
            ).alias("summary"),
        ).alias("observability"),
        F.struct(
            F.struct(F.lit(10.5).alias("end_to_end_rows_per_second")).alias("throughput"),
            F.struct(F.lit(100_000).alias("sample_count"), F.lit(5).alias("p50_ms"), unless(31, 9, 4).alias("p95_ms")).alias("freshness"),
        ).alias("benchmark"),
        F.array(*recovery).alias("recovery_measurements"),
    )
    text = F.to_json(document)
    return spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(
        F.concat(F.lit("record-"), c.cast("string")).alias("name"),
        F.when(c % 43 == 0, "unknown").otherwise(kind).alias("kind"),
        F.when(c % 41 == 0, F.substring(text, 1, 100)).otherwise(text).alias("document"),
    )


def nested_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9n: nested contracts, two versions per part; the part number decides what the second changes."""
    address = '{"type":"record","name":"Address","namespace":"shop","fields":[{"name":"street","type":"string"},{"name":"zip","type":"%s"}%s]}'
    state = '{"type":"enum","name":"State","symbols":[%s]%s}'

    def contract(address_: str, home: str = '"shop.Address"', tags: str = "string", state_: str = state % ('"A","B"', ""), tail: str = "") -> str:
        return (
            '{"type":"record","name":"Part","fields":['
            f'{{"name":"id","type":"long"}},{{"name":"origin","type":{address_}}},{{"name":"home","type":{home}}},'
            f'{{"name":"tags","type":{{"type":"array","items":"{tags}"}}}},{{"name":"state","type":{state_}}},'
            f'{{"name":"next","type":["null","Part"],"default":null}}{tail}]}}'
        )

    plain = address % ("int", "")
    first = contract(plain)
    seconds = [
        first.replace('"name":"Part",', "").replace('{"type":"record",', '{"name":"Part","type":"record",', 1),  # other order of keys
        contract(address % ("long", "")),  # a nested field is promoted
        contract(address % ("int", ',{"name":"floor","type":"int"}')),  # a nested field without default
        contract(address % ("int", ',{"name":"floor","type":"int","default":0}')),
        contract(plain, home='["null","shop.Address"]'),  # a place becomes a union
        contract(plain, tags="int"),  # items of another type
        contract(plain, state_=state % ('"A"', "")),  # a symbol is lost
        contract(plain, state_=state % ('"A"', ',"default":"A"')),
        contract(plain, home='"Nowhere"'),  # a reference without definition
        contract(address % ("int", ""))[:-2],  # cut off
        contract(plain, tail=',{"name":"size","type":{"type":"map","values":"long"},"default":{}}'),
    ]
    p = F.col("p_partkey")
    second = F.element_at(F.array(*[F.lit(s) for s in seconds]), (p % len(seconds) + 1).cast("int"))
    return spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(
        F.concat(F.lit("part-"), p.cast("string")).alias("subject"),
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("version"), F.lit(first).alias("schema_json")),
                F.struct(F.lit(2).alias("version"), second.alias("schema_json")),
            )
        ),
    )
