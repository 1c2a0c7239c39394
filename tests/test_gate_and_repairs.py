"""Admission gate, repairs, snapshot hand-over, redelivery and linkage over small logs."""

from __future__ import annotations

import json
import shutil

import pytest
from helpers import envelope, log, order, rows
from pyspark.sql import functions as F

from tidemark.operators import epochs, maintenance
from tidemark.operators.audits import miskey_audit
from tidemark.operators.decode import decode
from tidemark.schemas import LOG_RECORD, ORDER_COLUMNS, ORDER_ROW, REPAIR_FORMAT
from tidemark.sources import cdc_log, checkpoints
from tidemark.sources.tables import TableSet
from tidemark.streaming import dedup, gate, jobs, repairs, snapshot


def records(spark, *items):
    """(partition, offset, timestamp, key, value) each."""
    return spark.createDataFrame([("t", p, o, ts, str(k).encode(), v) for p, o, ts, k, v in items], LOG_RECORD)


def creation(order_id, event_id):
    return envelope("c", after=order(order_id, event_id))


BATCHES = [
    # 1 in order, 2 in order, 3 under a foreign key, 5 deleted and created again
    [(0, 0, 10, 1, creation(1, 10)), (1, 0, 11, 2, creation(2, 20)), (2, 0, 12, 99, creation(3, 30)), (0, 1, 13, 5, creation(5, 50))],
    # 2 falls back, 1 goes on, 5 is deleted under its last event id
    [(1, 1, 20, 2, creation(2, 19)), (1, 2, 21, 2, creation(2, 21)), (0, 2, 22, 1, creation(1, 11)), (0, 3, 23, 5, envelope("d", before=order(5, 50)))],
    # good records of rejected keys stay apart; a key's null; junk passes to quarantine
    [(1, 3, 30, 2, creation(2, 22)), (2, 1, 31, 3, creation(3, 31)), (0, 4, 32, 1, creation(1, 12)), (0, 5, 33, 5, creation(5, 51)), (0, 6, 34, 6, b"junk")],
]


@pytest.mark.parametrize("full_every", [16, 2])
def test_the_gate_carries_its_knowledge_over_batches(spark, tmp_path, monkeypatch, full_every):
    monkeypatch.setattr(gate, "FULL_EVERY", full_every)
    t = TableSet(spark, str(tmp_path)).ensure()
    for number, batch in enumerate(BATCHES):
        with pytest.raises(RuntimeError, match="injected"):
            jobs.write_batch(t, records(spark, *batch), number, jobs.fault_once("before_commit", number), gated=True)
        jobs.write_batch(t, records(spark, *batch), number, gated=True)
    state = gate.high_water(t)
    assert {r.order_id: r.rejected_in for r in state.collect()} == {1: None, 2: 1, 3: 0, 5: None}
    # the same as one look at all records that have an order
    everything = gate.gate_rows(decode(records(spark, *sum(BATCHES, [])))).where("event_id IS NOT NULL")
    want = {r.order_id: r for r in miskey_audit(everything).collect()}
    for r in gate.gate_audit(state).collect():
        same = {c: r[c] == want[r.order_id][c] for c in r.asDict()}
        assert all(same.values()) or (r.order_id == 5 and r.records == want[5].records + 1), same
    assert rows(gate.admitted_current(t), "order_id", "event_id") == [(1, 12), (5, 51)]
    # what 2 sent before it fell back is in the changelog, nothing of it afterwards
    assert rows(t.changelog().where("order_id IN (2, 3)"), "order_id", "event_id") == [(2, 20)]
    assert rows(t.committed("isolated"), "order_id", "offset") == [(2, 1), (2, 2), (2, 3), (3, 0), (3, 1)]
    assert t.dead_letters().count() == 1
    assert t.offsets() == {"t:0": 7, "t:1": 4, "t:2": 2}
    assert t.commits().agg(F.sum("changelog_rows")).first()[0] == t.changelog().count() == 7


def test_the_gate_reads_one_full_state_and_later_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gate, "FULL_EVERY", 3)
    t = TableSet(spark, str(tmp_path)).ensure()
    for n in range(5):
        jobs.write_batch(t, records(spark, (0, n, n, n, creation(n, n))), n, gated=True)
    # the parts before the last full state are not looked at
    for old in range(3):
        shutil.rmtree(f"{tmp_path}/gate/epoch=0/batch={old}")
    assert sorted(r.order_id for r in gate.high_water(t).collect()) == [0, 1, 2, 3, 4]
    assert [r.order_id for r in gate.high_water(t, keys=(2, 3)).orderBy("order_id").collect()] == [2, 3]
    jobs.write_batch(t, records(spark, (0, 9, 9, 1, None)), 5, gated=True)  # a tombstone alone
    assert gate.high_water(t).count() == 5 and t.offsets() == {"t:0": 10}


def repair_document(row, op="c"):
    names = [f.name for f in ORDER_ROW.fields]
    after = dict(zip(names, row, strict=True)) | {"updated_at": 1767225600000}
    return json.dumps({"repair_format": REPAIR_FORMAT, "intended_operation": op, "intended_after": after}).encode()


def test_repairs_reach_the_tables_once(spark, tmp_path):
    t = TableSet(spark, str(tmp_path)).ensure()
    good, bad = repair_document(order(1, 10)), repair_document(order(2, 20), "x")
    jobs.write_batch(
        t,
        records(spark, (0, 0, 1, 1, good), (0, 1, 2, 2, bad), (0, 2, 3, 3, b"junk"), (0, 3, 4, 1, envelope("u", order(1, 10), order(1, 11)))),
        0,
    )
    assert repairs.commit_repairs(t) == {"tried": 2, "resolved": 1, "failed": 1}
    # the repaired creation lies before the update in the log, so the update still holds
    assert rows(t.current(), "order_id", "event_id") == [(1, 11)]
    assert rows(t.changelog(), "offset", "image_seq") == [(0, 0), (3, 0), (3, 1)]
    states = {r.offset: (r.status, r.attempts, r.patch, r.last_error) for r in repairs.letter_states(t).collect()}
    assert states == {0: ("resolved", 1, 0, None), 1: ("failed", 1, None, "UnsupportedOperation"), 2: ("open", 0, None, "MalformedEnvelope")}
    again = t.patched("repair_letters").collect()
    assert [(r.original_offset, r.error_type) for r in again] == [(1, "UnsupportedOperation")]
    before = sorted(t.scan("patches").inputFiles()), rows(repairs.attempts(t))
    assert repairs.commit_repairs(t) == {"tried": 0, "resolved": 0, "failed": 0}
    assert (sorted(t.scan("patches").inputFiles()), rows(repairs.attempts(t))) == before

    given = [("t", 0, 1, repair_document(order(2, 20))), ("t", 0, 2, repair_document(order(3, 30))), ("t", 0, 0, repair_document(order(1, 99))), ("t", 5, 5, good)]
    documents = spark.createDataFrame(given, "topic string, partition int, offset long, document binary")
    assert repairs.commit_repairs(t, documents) == {"tried": 2, "resolved": 2, "failed": 0}
    assert rows(t.current(), "order_id", "event_id") == [(1, 11), (2, 20), (3, 30)]
    assert {r.offset: (r.status, r.attempts, r.patch) for r in repairs.letter_states(t).collect()} == {0: ("resolved", 1, 0), 1: ("resolved", 2, 1), 2: ("resolved", 1, 1)}
    # the stream goes on with numbers of its own; a base keeps the patches
    jobs.write_batch(t, records(spark, (0, 4, 5, 3, envelope("d", before=order(3, 30)))), 1)
    assert rows(t.current(), "order_id") == [(1,), (2,)] and rows(t.current(upto=0), "order_id") == [(1,), (2,), (3,)]
    maintenance.compact_current(t)
    assert rows(t.current(), "order_id") == [(1,), (2,)] and rows(t.current(upto=0), "order_id") == [(1,), (2,), (3,)]


def test_an_unfinished_patch_is_invisible(spark, tmp_path):
    t = TableSet(spark, str(tmp_path)).ensure()
    jobs.write_batch(t, records(spark, (0, 0, 1, 1, repair_document(order(1, 10)))), 0)
    real = t.commit_patch
    object.__setattr__(t, "commit_patch", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("down")))
    with pytest.raises(RuntimeError, match="down"):
        repairs.commit_repairs(t)
    assert t.current().count() == 0 and [r.status for r in repairs.letter_states(t).collect()] == ["open"]
    object.__setattr__(t, "commit_patch", real)
    assert repairs.commit_repairs(t)["resolved"] == 1
    assert rows(t.current(), "order_id") == [(1,)] and t.scan("patches").count() == 1


def test_snapshot_chunks_and_the_log_in_between(spark, tmp_path):
    t, path = TableSet(spark, str(tmp_path / "t")).ensure(), str(tmp_path / "log")
    source = {i: order(i, i) for i in range(1, 9)}
    records(spark, (0, 0, 1, 1, creation(1, 1))).write.parquet(path)
    reads = []

    def read_source():
        reads.append(dict(source))
        if len(reads) == 3:  # while the second chunk is read: a change of the row, then its log record
            record = envelope("u", source[4], order(4, 40))
            records(spark, (0, 1, 2, 4, record)).write.mode("append").parquet(path)
        return spark.createDataFrame(list(source.values()), ORDER_ROW)

    def after_chunk(chunk):
        if chunk == 1:
            del source[1]
            records(spark, (0, 2, 3, 1, envelope("d", before=order(1, 1)))).write.mode("append").parquet(path)
            raise RuntimeError("down")

    with pytest.raises(RuntimeError, match="down"):
        snapshot.run_snapshot(t, read_source, path, "t", 0, 2, after_chunk)
    first = snapshot.hand_over(t).first()
    assert (first.planned_chunks, first.committed_chunks, first.past_marks, first.complete) == (4, 2, False, False)
    source[4] = order(4, 40)
    assert snapshot.run_snapshot(t, read_source, path, "t", 0, 2) == 2
    assert snapshot.run_snapshot(t, read_source, path, "t", 0, 2) == 0
    # the row of 4 changed between the marks of its chunk and is left to the log
    assert 4 not in {r.order_id for r in t.scan("patches").collect()}
    jobs.run_ingest(cdc_log.stream_log(spark, path), t, str(tmp_path / "cp"))
    assert rows(t.current(), "order_id", "event_id") == [(2, 2), (3, 3), (4, 40), (5, 5), (6, 6), (7, 7), (8, 8)]
    last = snapshot.hand_over(t).first()
    assert last.complete and last.snapshot_rows == 7


def test_a_snapshot_of_nothing(spark, tmp_path):
    t, path = TableSet(spark, str(tmp_path / "t")).ensure(), str(tmp_path / "log")
    log(spark).write.parquet(path)
    assert snapshot.run_snapshot(t, lambda: spark.createDataFrame([], ORDER_ROW), path, "t", 0) == 1
    assert t.current().count() == 0 and snapshot.hand_over(t).first().complete


def test_redelivery_is_dropped_with_bounded_state(spark, tmp_path):
    path = str(tmp_path / "log")
    for n in range(8):  # each file repeats the one before
        part = [(0, o, (o + 1) * 1000, o, creation(o, o)) for o in range(max(0, (n - 1) * 10), n * 10 + 10)]
        records(spark, *part).coalesce(1).write.mode("append").parquet(path)
    t = TableSet(spark, str(tmp_path / "t")).ensure()
    once = dedup.drop_redelivered(cdc_log.stream_log(spark, path, max_files_per_trigger=1), "25 seconds")
    query = jobs.start_ingest(once, t, str(tmp_path / "cp"))
    query.awaitTermination()
    assert t.changelog().count() == t.changelog().select("offset").distinct().count() == 80
    assert 0 < dedup.most_state_rows(query.recentProgress) <= 60


def test_linkage_reads_checkpoint_and_ledger(spark, tmp_path):
    path, cp = str(tmp_path / "log"), str(tmp_path / "cp")
    t = TableSet(spark, str(tmp_path / "t")).ensure()
    records(spark, (0, 0, 1, 1, creation(1, 1)), (1, 0, 1, 2, creation(2, 2))).coalesce(1).write.parquet(path)
    jobs.run_ingest(cdc_log.stream_log(spark, path, max_files_per_trigger=1), t, cp)
    records(spark, (0, 1, 2, 1, None)).coalesce(1).write.mode("append").parquet(path)
    stale = checkpoints.stream_linkage(t, cp, cdc_log.read_log(spark, path), "r").first()
    assert not stale.lag_zero and not stale.complete
    jobs.run_ingest(cdc_log.stream_log(spark, path, max_files_per_trigger=1), t, cp)
    row = checkpoints.stream_linkage(t, cp, cdc_log.read_log(spark, path), "r").first()
    assert row.complete and (row.checkpoint_id, row.ledger_batch_id, row.changelog_snapshot_id) == (1, 1, 0)
    batches = checkpoints.checkpoint_batches(spark, cp).orderBy("batch_id").collect()
    assert [(b.batch_id, b.completed) for b in batches] == [(0, True), (1, True)] and batches[0].started_at_ms > 0
    assert "logOffset" in batches[1].source_offsets[0]


def test_differences_are_found_by_bucket(spark):
    source = spark.createDataFrame([order(i) for i in range(400)], ORDER_ROW)
    changed = source.where("order_id <> 7").withColumn("amount_cents", F.when(F.col("order_id") == 9, 1).otherwise(F.col("amount_cents")))
    got = epochs.located_diff(source, changed, "order_id", ORDER_COLUMNS).collect()
    assert {(r.order_id, r.state) for r in got} == {(7, "missing"), (9, "changed")}
    buckets = epochs.differing_buckets(source, changed, "order_id", ORDER_COLUMNS)
    assert len(buckets) == 2 == len({r.bucket for r in got} & set(buckets))
    assert epochs.located_diff(source, source, "order_id", ORDER_COLUMNS).count() == 0
    assert epochs.differing_buckets(source.limit(0), source.limit(0), "order_id", ORDER_COLUMNS) == []
