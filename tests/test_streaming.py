from __future__ import annotations

import pytest
from helpers import envelope, log, order, rows
from pyspark.sql import functions as F

from tidemark.operators import maintenance
from tidemark.operators.decode import changes, decode, drop_update_before
from tidemark.schemas import CHANGE
from tidemark.sources import cdc_log
from tidemark.sources.tables import TableSet, snapshot_summary
from tidemark.streaming import coalesce, jobs, progress

A1, A2, B1, C1 = order(1303), order(1303, 9, "paid"), order(1304, 2), order(1305, 3)
D1 = order(2302, 4)


def write_log(spark, path, *batches):
    """One file per batch, offsets running on."""
    offset = 0
    for batch in batches:
        df = log(spark, *batch).withColumn("offset", F.col("offset") + offset)
        df.withColumn("timestamp_ms", F.col("offset") + 1000).coalesce(1).write.mode("append").parquet(path)
        offset += len(batch)


def recovery_log(spark, path):
    """Four inserts, two updates, one delete: 9 images, 3 live rows."""
    b2 = order(1304, 8, "paid")
    write_log(
        spark,
        path,
        [envelope("c", after=A1), envelope("c", after=B1), envelope("c", after=C1)],
        [envelope("u", A1, A2), envelope("d", before=C1)],
        [envelope("c", after=D1), envelope("u", B1, b2)],
    )


@pytest.mark.parametrize("point", jobs.FAULT_POINTS)
def test_one_fault_anywhere_changes_nothing(spark, tmp_path, point):
    path, t = str(tmp_path / "log"), TableSet(spark, str(tmp_path / "t"))
    recovery_log(spark, path)
    stream = cdc_log.stream_log(spark, path, max_files_per_trigger=1)
    used = jobs.run_ingest(stream, t, str(tmp_path / "cp"), pause_seconds=0, fault=jobs.fault_once(point, 1))
    assert used == 1
    assert t.changelog().count() == 9
    assert t.changelog().select("event_id").distinct().count() == 6
    assert rows(t.current(), "order_id", "event_id") == [(1303, 9), (1304, 8), (2302, 4)]
    assert t.commits().count() == 3
    assert t.commits().agg(F.sum("changelog_rows")).first()[0] == 9


def test_uncommitted_batch_is_invisible_and_restarts_give_up(spark, tmp_path):
    path, t = str(tmp_path / "log"), TableSet(spark, str(tmp_path / "t"))
    recovery_log(spark, path)

    def always(point, batch):
        if point == "before_commit" and batch == 1:
            raise RuntimeError("down")

    stream = cdc_log.stream_log(spark, path, max_files_per_trigger=1)
    with pytest.raises(Exception, match="down"):
        jobs.run_ingest(stream, t, str(tmp_path / "cp"), restarts=1, pause_seconds=0, fault=always)
    assert t.scan("changelog").count() > t.changelog().count() == 3
    assert t.last_batch() == 0


def test_resume_savepoint_and_time_travel(spark, tmp_path):
    path, t = str(tmp_path / "log"), TableSet(spark, str(tmp_path / "t"))
    cp = str(tmp_path / "cp")
    write_log(spark, path, [envelope("c", after=A1), envelope("c", after=B1)])
    jobs.run_ingest(cdc_log.stream_log(spark, path), t, cp)
    jobs.savepoint(t, cp, cp + "-copy")
    log(spark, envelope("u", A1, A2), envelope("d", before=B1)).withColumn(
        "offset", F.col("offset") + 2
    ).write.mode("append").parquet(path)
    query = jobs.start_ingest(cdc_log.stream_log(spark, path), t, cp + "-copy")
    query.awaitTermination()
    assert rows(t.current(), "order_id", "event_id") == [(1303, 9)]
    assert rows(t.current(upto=0), "order_id") == [(1303,), (1304,)]
    assert [r.snapshot_id for r in t.snapshot_history().collect()] == [0, 1]
    samples = progress.progress_samples(spark, query)
    assert samples.where("error IS NULL").agg(F.sum("input_rows")).first()[0] == 2


def test_compaction_keeps_deletes_and_old_snapshots(spark, tmp_path):
    path, t = str(tmp_path / "log"), TableSet(spark, str(tmp_path / "t"))
    recovery_log(spark, path)
    jobs.run_ingest(cdc_log.stream_log(spark, path, max_files_per_trigger=1), t, str(tmp_path / "cp"))
    before, old = rows(t.current()), rows(t.current(upto=0))
    report = maintenance.compact_current(t)
    assert report["added_files"] == 1 <= report["rewritten_files"]
    assert rows(t.current()) == before and rows(t.current(upto=0)) == old
    # an old image delivered again after compaction must not bring a deleted key back
    jobs.write_batch(t, cdc_log.read_log(spark, path).where("offset = 2"), 3)
    assert rows(t.current()) == before


def test_an_unfinished_base_is_invisible(spark, tmp_path):
    path, t = str(tmp_path / "log"), TableSet(spark, str(tmp_path / "t"))
    recovery_log(spark, path)
    jobs.run_ingest(cdc_log.stream_log(spark, path, max_files_per_trigger=1), t, str(tmp_path / "cp"))
    before = rows(t.current())
    # a crash in the middle of compaction: some files of the base, no ledger row
    t.latest_images().limit(1).select(*CHANGE.fieldNames()).write.parquet(f"{t.root}/base/epoch=0/upto={t.last_batch()}")
    assert rows(t.current()) == before
    maintenance.compact_current(t)
    assert rows(t.current()) == before


def test_a_committed_batch_is_left_alone(spark, tmp_path):
    path, t = str(tmp_path / "log"), TableSet(spark, str(tmp_path / "t")).ensure()
    recovery_log(spark, path)
    records = cdc_log.read_log(spark, path)
    jobs.write_batch(t, records, 0)
    before, files = rows(t.current()), sorted(t.scan("changelog").inputFiles())
    jobs.write_batch(t, records.limit(1), 0)
    assert rows(t.current()) == before and sorted(t.scan("changelog").inputFiles()) == files


def test_offsets_count_tombstones_and_carry_over(spark, tmp_path):
    t = TableSet(spark, str(tmp_path / "t")).ensure()
    first = log(spark, envelope("c", after=A1), None)  # a tombstone at the log's end
    jobs.write_batch(t, first, 0)
    topic = first.first().topic
    assert t.offsets() == {f"{topic}:0": 2}
    jobs.write_batch(t, log(spark, envelope("c", after=B1)).withColumn("partition", F.lit(1)), 1)
    assert t.offsets() == {f"{topic}:0": 2, f"{topic}:1": 1}


def test_poison_does_not_stop_the_stream(spark, tmp_path):
    path, t = str(tmp_path / "log"), TableSet(spark, str(tmp_path / "t"))
    write_log(spark, path, ["junk", envelope("c", after=A1)], [envelope("c", after=B1)])
    jobs.run_ingest(cdc_log.stream_log(spark, path, max_files_per_trigger=1), t, str(tmp_path / "cp"))
    assert t.current().count() == 2 and t.dead_letters().count() == 1


def test_start_modes(spark, tmp_path):
    path, t = str(tmp_path / "log"), TableSet(spark, str(tmp_path / "t"))
    recovery_log(spark, path)
    with pytest.raises(ValueError, match="start must be"):
        cdc_log.stream_log(spark, path, start="latest")
    with pytest.raises(ValueError, match="needs timestamp_ms"):
        cdc_log.stream_log(spark, path, start="timestamp")
    stream = cdc_log.stream_log(spark, path, "timestamp", str(tmp_path / "starts"), 1005)
    jobs.run_ingest(stream, t, str(tmp_path / "cp"))
    assert rows(t.changelog(), "offset", "image_seq") == [(5, 0), (6, 0), (6, 1)]


def test_coalescer_emits_newest_per_key(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    recovery_log(spark, path)
    with pytest.raises(ValueError, match="positive"):
        coalesce.coalesce_changes(spark.range(1), 0)
    images = drop_update_before(changes(decode(cdc_log.stream_log(spark, path))))
    q = coalesce.start_coalesced(images, 1500, out, str(tmp_path / "cp"))
    try:
        jobs.wait_until(lambda: coalesce.all_quiet(q), "quiet keys", 90, query=q)
        first = rows(coalesce.quiet_images(spark.read.parquet(out)), "order_id", "event_id", "cdc_row_kind")
        plan = q._jsq.explainInternal(True)
        # a key that speaks again comes out again
        log(spark, envelope("u", D1, order(2302, 50))).withColumn("offset", F.lit(90).cast("long")).write.mode("append").parquet(path)
        jobs.wait_until(lambda: spark.read.parquet(out).where("event_id = 50").count() == 1, "the later change", 90, query=q)
    finally:
        coalesce.stop_between_batches(q)
    assert first == [(1303, 9, "+U"), (1304, 8, "+U"), (1305, 3, "-D"), (2302, 4, "+I")]
    assert spark.read.parquet(out).count() == 5
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_wait_until_reports_last_error():
    def fails():
        raise KeyError("nope")

    with pytest.raises(TimeoutError, match="nope"):
        jobs.wait_until(fails, "nothing", 0.2, 0.05)


def test_snapshot_summary_counts_total_and_added(spark):
    h = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "table_name string, snapshot_id long, committed_at_epoch_ms long")
    files = spark.createDataFrame([("a", 1, "deletes"), ("a", 2, "deletes"), ("a", 2, "data")], "table_name string, snapshot_id long, content string")
    row = snapshot_summary(h, files).first()
    assert (row.total_delete_files, row.added_delete_files, row.current_snapshot_id) == (2, 1, 2)


def test_written_files_keep_their_limits(spark, tmp_path):
    path, t = str(tmp_path / "log"), TableSet(spark, str(tmp_path / "t"), file_rows=2, row_group_bytes=1 << 16)
    recovery_log(spark, path)
    jobs.run_ingest(cdc_log.stream_log(spark, path), t, str(tmp_path / "cp"))
    maintenance.compact_current(t)
    again = t.next_epoch()
    assert (again.file_rows, again.epoch) == (2, 1)
    for dataset in ("changelog", "base"):
        per_file = t.scan(dataset).groupBy(F.col("_metadata.file_path")).count().collect()
        assert per_file and max(r["count"] for r in per_file) <= 2
        assert t.files(dataset).count() >= len(per_file)
    assert maintenance.planned_scan_tasks(t.scan("base")) >= 1
    assert {r.dataset for r in maintenance.table_files(t, ["changelog", "base"]).collect()} == {"changelog", "base"}


def test_progress_of_every_batch_is_kept(spark, tmp_path):
    path, t = str(tmp_path / "log"), TableSet(spark, str(tmp_path / "t"))
    recovery_log(spark, path)
    sampler = progress.ProgressSampler(spark, str(tmp_path / "samples"))
    spark.streams.addListener(sampler)
    try:
        jobs.run_ingest(cdc_log.stream_log(spark, path, max_files_per_trigger=1), t, str(tmp_path / "cp"))
        jobs.wait_until(lambda: spark.read.schema(progress.SAMPLE_DDL).parquet(str(tmp_path / "samples")).count() >= 3, "samples", 60)
    finally:
        spark.streams.removeListener(sampler)
    samples = spark.read.parquet(str(tmp_path / "samples"))
    assert samples.where("error IS NULL").agg(F.sum("input_rows")).first()[0] == 7
    broken = progress._sample(0, {"batchId": 1})
    assert broken[-1].startswith("KeyError")


def test_slow_batches_of_the_clock_alone_are_quiet(spark, tmp_path):
    """Batches further apart than the quiet period: the clock leaves no session that looks like a pending key."""
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    recovery_log(spark, path)
    images = drop_update_before(changes(decode(cdc_log.stream_log(spark, path))))
    q = coalesce.start_coalesced(images, 500, out, str(tmp_path / "cp"), interval="3 seconds")
    try:
        jobs.wait_until(lambda: coalesce.all_quiet(q), "quiet keys", 60, query=q)
        assert coalesce.pending_keys(q) == 0
    finally:
        coalesce.stop_between_batches(q)
    assert rows(coalesce.quiet_images(spark.read.parquet(out)), "order_id") == [(1303,), (1304,), (1305,), (2302,)]
