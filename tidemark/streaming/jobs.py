"""Log to tables: decode each micro-batch once, write three outputs, commit once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from tidemark.operators.decode import (
    changes,
    dead_letters,
    decode,
    drop_update_before,
)
from tidemark.operators.state import latest_per_key
from tidemark.sources.tables import TableSet
from tidemark.streaming import gate

FAULT_POINTS = ("before_write", "between_writes", "before_commit", "after_commit")
FaultHook = Callable[[str, int], None]


def fault_once(point: str, batch_id: int) -> FaultHook:
    """A hook that fails the first time the given point of the given batch is reached."""
    if point not in FAULT_POINTS:
        raise ValueError(f"fault point must be one of {FAULT_POINTS}")
    armed = [True]

    def hook(at: str, batch: int) -> None:
        if armed[0] and at == point and batch == batch_id:
            armed[0] = False
            raise RuntimeError(f"injected fault {at} in batch {batch}")

    return hook


def write_batch(
    tables: TableSet, records: DataFrame, batch_id: int, fault: FaultHook | None = None, gated: bool = False
) -> None:
    """One commit. Running it again before the commit replaces what it wrote, afterwards it does nothing.

    With ``gated`` the records of keys that the admission gate rejects go to ``isolated``.
    """
    reached = fault or (lambda point, batch: None)
    last, offsets = tables.newest_commit()
    if batch_id <= last:
        return
    outcomes = decode(records, tombstones=True)
    # dead letters need the bytes again, and so do records that a gate may keep apart
    needed = F.col("error").isNotNull() | F.lit(gated)
    bytes_of = {c: F.when(needed, F.col(c)) for c in ("key", "value")}
    decoded = outcomes.withColumns(bytes_of).persist(StorageLevel.MEMORY_AND_DISK)
    kept = decoded
    try:
        reached("before_write", batch_id)
        if gated:
            tables.write_part("gate", batch_id, gate.next_state(tables, gate.gate_rows(decoded), batch_id))
            state = tables.scan("gate").where((F.col("epoch") == tables.epoch) & (F.col("batch") == batch_id))
            kept = gate.split(decoded, state).persist(StorageLevel.MEMORY_AND_DISK)
            apart = kept.where(~F.col("admitted") & (F.col("image.image_seq") == 0))
            tables.write_part("isolated", batch_id, apart)
            admitted = kept.where("admitted")
        else:
            admitted = kept
        images = changes(admitted)
        tables.write_part("changelog", batch_id, images)
        reached("between_writes", batch_id)
        tables.write_part("current", batch_id, latest_per_key(drop_update_before(images)))
        # one row per log partition; a tombstone moves the position too, and so does a record kept apart
        mine = F.col("admitted") if gated else F.lit(True)
        ends = (
            kept.groupBy("topic", "partition")
            .agg(
                (F.max("offset") + 1).alias("next_offset"),
                F.count(F.when(mine, F.col("image"))).alias("images"),
                F.count("error").alias("errors"),
            )
            .collect()
        )
        errors = sum(r.errors for r in ends)
        if errors:
            tables.write_part("dead_letters", batch_id, dead_letters(decoded))
        reached("before_commit", batch_id)
        tables.commit(
            batch_id,
            sum(r.images for r in ends),
            errors,
            {f"{r.topic}:{r.partition}": r.next_offset for r in ends},
            offsets,
        )
        reached("after_commit", batch_id)
    finally:
        if gated:
            kept.unpersist()
        decoded.unpersist()


def start_ingest(
    log: DataFrame,
    tables: TableSet,
    checkpoint: str,
    trigger: dict | None = None,
    fault: FaultHook | None = None,
    gated: bool = False,
) -> StreamingQuery:
    """Start the job. The checkpoint remembers the position; keep it to resume."""
    tables.ensure()
    return (
        log.writeStream.foreachBatch(lambda df, batch: write_batch(tables, df, batch, fault, gated))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_ingest(
    log: DataFrame,
    tables: TableSet,
    checkpoint: str,
    restarts: int = 3,
    pause_seconds: float = 3.0,
    fault: FaultHook | None = None,
    gated: bool = False,
) -> int:
    """Read all available data, restarting from the checkpoint on failure; returns restarts used."""
    for attempt in range(restarts + 1):
        query = start_ingest(log, tables, checkpoint, fault=fault, gated=gated)
        try:
            query.awaitTermination()
            return attempt
        except Exception:
            if attempt == restarts:
                raise
            time.sleep(pause_seconds)
    raise AssertionError("unreachable")


def savepoint(tables: TableSet, checkpoint: str, target: str) -> None:
    """Copy the recovery state of a stopped query; a new query may start from the copy."""
    jvm = tables.spark._jvm
    conf = tables.spark._jsc.hadoopConfiguration()
    source, copy = jvm.org.apache.hadoop.fs.Path(checkpoint), jvm.org.apache.hadoop.fs.Path(target)
    ok = jvm.org.apache.hadoop.fs.FileUtil.copy(
        source.getFileSystem(conf), source, copy.getFileSystem(conf), copy, False, False, conf
    )
    if not ok:
        raise RuntimeError(f"could not copy {checkpoint} to {target}")


def wait_until(
    check: Callable[[], bool],
    what: str,
    timeout_seconds: float,
    interval: float = 1.0,
    query: StreamingQuery | None = None,
) -> None:
    """Poll until ``check`` holds; errors of a poll are kept and shown on timeout.

    With ``query`` the wait also ends when that query does; the timeout may then be infinite.
    """
    deadline, last_error = time.monotonic() + timeout_seconds, None
    while time.monotonic() < deadline:
        try:
            if check():
                return
        except Exception as error:
            last_error = error
        if query is not None and not query.isActive:
            raise RuntimeError(f"the query ended before {what}: {query.exception() or last_error}")
        time.sleep(interval)
    raise TimeoutError(f"timed out waiting for {what}" + (f"; last error: {last_error}" if last_error else ""))
