from __future__ import annotations

import pytest
from helpers import image, images, order, orders, rows
from pyspark.sql import functions as F

from tidemark.operators import audits, contracts, measures, offsets, quality
from tidemark.sources import cdc_log, reports, runs, tables, workload


def probe(spark, order_id, events, keys=None, partitions=None):
    n = len(events)
    keys, partitions = keys or [order_id] * n, partitions or [0] * n
    return spark.createDataFrame(
        [(keys[i], order_id, events[i], partitions[i], i, 1000 + i) for i in range(n)],
        "key_order_id long, order_id long, event_id long, partition int, offset long, timestamp_ms long",
    )


def test_ordering_law(spark):
    for events, expected in (([100, 101, 102], 0), ([100, 102, 101], 1)):
        got = audits.monotonic_violations(probe(spark, 1, events), ["timestamp_ms"], F.lit(0)).first()
        assert got.violations == expected


def test_miskey_and_gate(spark):
    bad = probe(spark, 2, [2003030, 2003032, 2003031], [101, 102, 103], [0, 1, 2])
    both = bad.unionAll(probe(spark, 1, [1, 2, 3]))
    audit = audits.miskey_audit(both, block_ms=1)
    verdict = {r.order_id: r for r in audit.collect()}
    assert (verdict[2].order_violations, verdict[2].would_corrupt, verdict[2].disposition) == (1, True, "reject")
    assert (verdict[1].mismatched_keys, verdict[1].spans_partitions, verdict[1].disposition) == (0, False, "admit")
    gate = audits.admission_gate(both, audit)
    assert rows(gate.where("admitted"), "order_id") == [(1,)] * 3


def test_duplicates(spark):
    once = images(spark, *[image(i, "+I", order(i + 1)) for i in range(36)])
    twice = once.unionAll(once)
    counts = audits.duplicate_counts(twice).first()
    assert (counts.changelog_rows, counts.duplicate_occurrences, counts.distinct_ids) == (72, 36, 36)
    assert audits.duplicate_event_ids(once).count() == audits.record_duplicates(once).count() == 0
    measured = "changelog_rows long, duplicate_occurrences long, replayed long"
    target = audits.replay_targets(spark.createDataFrame([(36, 0, 36)], measured)).first()
    assert (target.expected_changelog_rows, target.expected_duplicate_occurrences) == (72, 36)
    with pytest.raises(Exception, match="negative"):
        audits.replay_targets(spark.createDataFrame([(-1, 0, 0)], measured)).collect()
    audit = audits.redelivery_audit(twice, orders(spark, order(1))).first()
    assert audit.passed and audit.duplicate_occurrences == 36


def test_event_id_audit_and_suite(spark):
    source = orders(spark, order(1), order(2))
    row = audits.event_id_audit(source, orders(spark, order(2)), images(spark, image(0, "+I", order(1))))
    assert not row.first().current_event_ids_match
    checks = audits.checks_of(
        row, {"ids": F.col("current_event_ids_match"), "rows": F.col("changelog_rows") == 1, "void": F.lit(None).cast("boolean")}
    )
    assert tuple(audits.check_suite(checks).first()) == (False, 3, "ids,void")


def test_group_lag_rules(spark):
    ends = spark.createDataFrame([(0, 5), (1, 0), (2, 4), (3, 3)], "partition int, log_end_offset long")
    group = spark.createDataFrame([(0, 7, 5), (3, 1, 2)], "partition int, current_offset long, log_end_offset long")
    got = rows(offsets.group_lag(ends, group))
    assert got == [(0, 7, 5, 0, True), (1, 0, 0, 0, True), (2, None, 4, None, False), (3, 1, 3, 2, False)]
    assert not offsets.lag_summary(offsets.group_lag(ends, group)).first().complete


def test_reports(spark):
    text = lambda *lines: spark.createDataFrame([(x,) for x in lines], "value string")
    ends = reports.parse_end_offsets(text("a:b:0:12", "other:0:1", "a:b:x"), "a:b")
    assert rows(ends) == [(0, 12, None), (None, None, "a:b:x")]
    group = reports.parse_group_offsets(
        text("GROUP TOPIC PARTITION", "g t 0 3 5 2 c h", "g t 1 - 5 - c h"), "g", "t"
    )
    assert rows(group, "partition", "lag") == [(0, 2), (1, None)]
    with pytest.raises(ValueError, match="malformed or uncommitted"):
        reports.require_rows(group, "group report")
    with pytest.raises(ValueError, match="no rows"):
        reports.require_rows(ends.where("false"), "end report")
    reset = reports.parse_reset_offsets(text("GROUP TOPIC g.1 t 0 0 g.1 t 1 7 gx1 t 2 0"), "g.1", "t")
    assert rows(reset) == [(0, 0), (1, 7)]


def test_metric_lines(spark):
    lines = spark.createDataFrame(
        [
            ("# HELP x",),
            ("",),
            ('jm_lastCheckpointDuration{job_id="abc",name="a=b",q="x\\"y"} 42',),
            ('jm_lastCheckpointDuration{job_id="other"} 900',),
            ('tm_backPressuredTimeMsPerSecond{job_id="abc"} 0',),
            ('tm_busyTimeMsPerSecond{job_id="abc"} 6.2e2',),
            ("tm_checkpointAlignmentTime 2500000",),
            ("no value here",),
        ],
        "value string",
    )
    metrics = reports.parse_metrics(lines)
    assert metrics.count() == 5
    first = metrics.where("metric_value = 42").first()
    assert first.labels == {"job_id": "abc", "name": "a=b", "q": 'x"y'}
    snap = measures.reporter_snapshot(metrics, [], job="abc").first()
    assert (snap.checkpoint_duration_ms, snap.checkpoint_alignment_time_ms) == (42.0, 2.5)
    assert snap.backpressure_indicator == 0.62
    assert measures.max_metric(metrics, ["lastCheckpointDuration"]).first().max_value == 900


@pytest.mark.parametrize(
    ("pressured", "flag", "busy", "expected"),
    [(250.0, None, 900.0, 0.25), (0.0, 1.0, None, 1.0), (0.0, 0.0, 620.0, 0.62), (0.0, None, None, 0.0), (None, None, None, None), (5000.0, None, None, 1.0)],
)
def test_backpressure_indicator(spark, pressured, flag, busy, expected):
    df = spark.createDataFrame([(pressured, flag, busy)], "p double, f double, b double")
    assert df.select(measures.backpressure_indicator(F.col("p"), F.col("f"), F.col("b"))).first()[0] == expected


def test_zero_lag_runs_across_blocks(spark):
    lags = [3, 0, 0, 2, 0, 0, 0, 0]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(lags)], "series string, sample_index long, lag_events long")
    got = measures.zero_lag_runs(df, ["series"], width=2).orderBy("sample_index").collect()
    assert [r.zero_run for r in got] == [0, 1, 2, 0, 1, 2, 3, 4]
    assert [r.recovered for r in got][-2:] == [True, True]
    states = df.withColumn("state", F.when(F.col("lag_events") > 0, "busy"))
    moved = measures.state_transitions(states, ["series"], "sample_index", "state", width=3)
    assert rows(moved, "sample_index") == [(0,), (1,), (3,), (4,)]


def test_interval_join_spans_cuts(spark):
    batches = spark.createDataFrame([(1, 1, 9), (2, 10, 11)], "batch long, first_event_id long, last_event_id long")
    events = spark.range(1, 13).withColumnRenamed("id", "event_id")
    got = measures.events_in_batches(events, batches, "event_id", width=4)
    assert rows(got.groupBy("batch").count()) == [(1, 9), (2, 2)]


def registry(spark, *versions):
    import json

    return spark.createDataFrame(
        [("s", v, json.dumps({"type": "record", "name": "R", "fields": f})) for v, f in versions],
        "subject string, version int, schema_json string",
    )


LONG, TEXT = {"name": "a", "type": "long"}, {"name": "b", "type": "string"}


@pytest.mark.parametrize(
    ("fields", "backward", "passed"),
    [
        ([LONG, TEXT, {"name": "c", "type": ["null", "string"], "default": None}], True, True),
        ([LONG, TEXT, {"name": "c", "type": "string"}], False, False),
        ([LONG], True, False),
        ([{"name": "a", "type": "string"}, TEXT], False, False),
        ([{"name": "a", "type": "double"}, TEXT], True, False),
    ],
)
def test_evolution(spark, fields, backward, passed):
    versions = registry(spark, (1, [LONG, TEXT]), (2, fields))
    row = contracts.evaluate_evolution(contracts.registry_fields(versions), 1, 2).first()
    assert (row.backward_compatible, row.passed) == (backward, passed)
    first, second = versions.where("version = 1"), versions.where("version = 2")
    assert contracts.admit_versions(first, second).count() == 1 + backward


def test_registry_rejects_and_fingerprint(spark):
    docs = ['{"type":"enum"}', '{"type":"record","fields":[]}', "x", '{"type":"record","fields":[{"type":"int"},{"name":"q"}]}']
    df = spark.createDataFrame([("s", i, d) for i, d in enumerate(docs)], "subject string, version int, schema_json string")
    problems = rows(contracts.registry_fields(df), "version", "problem")
    assert [p for _, p in problems] == [
        "root is not a record", "record has no fields", "schema is not JSON", "field without a name", "field without a type",
    ]
    same = spark.createDataFrame([("s", 1, '{"a":1,"b":2}'), ("s", 2, '{"b":2, "a":1}')], df.schema)
    assert contracts.contract_fingerprint(same).select("contract_sha256").distinct().count() == 1
    with pytest.raises(Exception, match="no field named"):
        contracts.mutate_types(contracts.registry_fields(registry(spark, (1, [LONG]))), "zz", "string").collect()


def test_key_constraints(spark):
    found = dict(rows(quality.key_constraints(orders(spark, order(1), order(1), order(2, status="x" * 40)))))
    assert (found["unique.order_id"], found["length.status"], found["not_null.seed"]) == (1, 1, 0)


def test_workload(spark):
    df = workload.generate_orders(spark, 500, 7)
    assert rows(df) == rows(workload.generate_orders(spark, 500, 7).repartition(7))
    stats = df.agg(F.min("amount_cents"), F.max("amount_cents"), F.countDistinct("status"), F.max("customer_id"), F.countDistinct("order_id")).first()
    assert stats[0] >= 100 and stats[1] < 250_100 and stats[2] == 5 and stats[3] <= 500 and stats[4] == 500
    with pytest.raises(ValueError, match="positive"):
        workload.generate_orders(spark, 0, 1)
    batch = df.select("event_id", F.lit(1).alias("r"), F.lit(5).alias("a"))
    assert workload.commit_batches(batch, 200, "event_id", "r", "a", first_id=1).count() == 3


def test_append_log(spark, tmp_path):
    from helpers import log

    path = str(tmp_path / "log")
    log(spark, "a", "b").write.parquet(path)
    new = log(spark, "c", "d").drop("offset").withColumn("n", F.col("timestamp_ms"))
    new = new.unionAll(new.withColumn("partition", F.lit(1)))
    placed = cdc_log.append_log(spark, path, new, ["n"], F.lit(0))
    assert rows(placed, "partition", "offset") == [(0, 2), (0, 3), (1, 0), (1, 1)]
    assert cdc_log.read_log_range(spark, path, 1, 3).count() == 3
    first = cdc_log.read_log_range(spark, path, max_records=3).collect()
    assert [(r.partition, r.offset) for r in first] == [(0, 0), (0, 1), (0, 2)]


def test_snapshot_tables(spark):
    h = spark.createDataFrame([("a", 1, 10), ("a", 2, 20)], "table_name string, snapshot_id long, committed_at_epoch_ms long")
    names = spark.createDataFrame([("a",), ("b",)], "table_name string")
    with pytest.raises(Exception, match="no snapshot for table b"):
        tables.latest_snapshots(h, names).collect()
    assert rows(tables.latest_snapshots(h, names.where("table_name = 'a'"))) == [("a", 2)]


def test_run_ledger(spark, tmp_path):
    stamp = {f: "x" for f in ("run_id", "git_sha", "started_at", "finished_at", "command", "logs")}
    stamp["stack_versions"] = {"spark": "4"}
    path = str(tmp_path / "ledger" / "one")
    runs.write_run_record(spark, path, stamp, {"failure_class": "poison-dlq", "phase": "B3"})
    with pytest.raises(Exception, match="exists"):
        runs.write_run_record(spark, path, stamp, {})
    with pytest.raises(ValueError, match="provenance lacks logs"):
        runs.write_run_record(spark, path + "2", {**stamp, "logs": None}, {})
    ledger = runs.read_run_ledger(spark, str(tmp_path / "ledger"))
    assert rows(runs.run_index(ledger), "name", "phase") == [("one", "B3")]
    broken = {r.rule for r in runs.validate_ledger(ledger).collect()}
    assert broken == {"drill.environment", "drill.diff_zero", "drill.linkage", "drill.checks", "poison.one_dead_letter"}


def test_numeric_paths(spark):
    docs = spark.createDataFrame([(1, '{"a":{"b":[1,"2.5",true,{}]},"c":null,"d":"x"}')], "id int, doc string")
    got = rows(reports.flatten_numeric_paths(docs, "doc", depth=4), "path", "number")
    assert got == [("a.b.0", 1.0), ("a.b.1", 2.5)]
    with pytest.raises(Exception, match="nested deeper"):
        reports.flatten_numeric_paths(docs, "doc", depth=1).collect()


def test_connector_states_hide_traces(spark):
    doc = '{"connector":{"state":"RUNNING"},"tasks":[{"id":0,"state":"FAILED","trace":"a.B: secret"}]}'
    out = reports.connector_states(spark.createDataFrame([(doc,)], "value string"))
    assert rows(out) == [("RUNNING", 0, "FAILED", "a.B")]
