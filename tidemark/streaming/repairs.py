"""Repairs of dead letters that reach the tables, and the life cycle of each letter.

A repair document says which row a quarantined record was meant to be: the record itself may
hold it, or an operator gives one for a log position. ``commit_repairs`` turns the documents
of open letters into records at their original position, decodes them and commits the images
as one patch: readers see them like the stream's own rows, in the order of the log. Whatever
cannot be decoded is a dead letter again, kept with the patch.

A letter is ``open`` until a patch resolves it, ``resolved`` after that, and ``failed`` while
its newest attempt did not decode. An attempt is known by position and document: a resolved
letter or a document that failed before is not tried again, so a second run changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tidemark.operators.decode import changes, dead_letters, decode
from tidemark.operators.replay import open_dead_letters, repaired_records
from tidemark.sources.tables import TableSet

POSITION = ["topic", "partition", "offset"]


def attempts(tables: TableSet) -> DataFrame:
    """Every committed repair attempt; ``patch`` tells which patch made it."""
    return tables.patched("repairs").withColumnRenamed("batch", "patch").drop("epoch")


def _newest_attempt(tables: TableSet) -> DataFrame:
    """Per position the number of attempts and the outcome of the newest."""
    return attempts(tables).groupBy(*POSITION).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.max_by(F.struct("error_type", "error_message", "patch"), "patch").alias("newest"),
        F.bool_or(F.col("error_type").isNull()).alias("resolved"),
        F.collect_set("document_sha256").alias("tried"),
    )


def letter_states(tables: TableSet) -> DataFrame:
    """One row per dead letter of the stream: status, attempts, resolving patch, last error."""
    letters = tables.dead_letters().select(
        F.col("original_topic").alias("topic"),
        F.col("original_partition").alias("partition"),
        F.col("original_offset").alias("offset"),
        F.col("error_type").alias("first_error"),
    )
    joined = letters.join(_newest_attempt(tables), POSITION, "left")
    return joined.select(
        *POSITION,
        "first_error",
        F.when(F.col("resolved"), "resolved").when(F.col("attempts") > 0, "failed").otherwise("open").alias("status"),
        F.coalesce("attempts", F.lit(0)).cast("bigint").alias("attempts"),
        F.when(F.col("resolved"), F.col("newest.patch")).alias("patch"),
        F.when(~F.coalesce("resolved", F.lit(False)), F.coalesce("newest.error_type", "first_error")).alias("last_error"),
    )


def _with_documents(letters: DataFrame, documents: DataFrame | None) -> DataFrame:
    """Letters with the operator's document in place of their own bytes, where there is one."""
    if documents is None:
        return letters
    given = documents.select(
        F.col("topic").alias("original_topic"),
        F.col("partition").alias("original_partition"),
        F.col("offset").alias("original_offset"),
        F.base64(F.col("document").cast("binary")).alias("__given"),
    ).dropDuplicates(["original_topic", "original_partition", "original_offset"])
    joined = letters.join(given, ["original_topic", "original_partition", "original_offset"], "left")
    return joined.withColumn("original_value_base64", F.coalesce("__given", "original_value_base64")).drop("__given")


def pending_repairs(tables: TableSet, documents: DataFrame | None = None) -> DataFrame:
    """Letters that hold or are given a repair document which has not been tried yet.

    ``documents`` has (topic, partition, offset, document); positions without a letter are
    ignored, and of several documents for one position one is taken.
    """
    letters = open_dead_letters(_with_documents(tables.dead_letters(), documents)).where("repairable")
    tried = _newest_attempt(tables).select(
        F.col("topic").alias("original_topic"),
        F.col("partition").alias("original_partition"),
        F.col("offset").alias("original_offset"),
        "resolved",
        "tried",
    )
    joined = letters.withColumn("document_sha256", F.sha2("original_value", 256)).join(
        tried, ["original_topic", "original_partition", "original_offset"], "left"
    )
    new = ~F.coalesce(F.array_contains("tried", F.col("document_sha256")), F.lit(False))
    return joined.where(~F.coalesce("resolved", F.lit(False)) & new).drop("resolved", "tried")


def commit_repairs(tables: TableSet, documents: DataFrame | None = None) -> dict[str, int]:
    """Commit what can be repaired as one patch; returns counts, and nothing is written without any.

    One writer of patches at a time; the stream may run on, its batches have numbers of their own.
    """
    tables.ensure()
    pending = pending_repairs(tables, documents).persist(StorageLevel.MEMORY_AND_DISK)
    decoded = decode(repaired_records(pending)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        outcome = decoded.groupBy(*POSITION).agg(F.max("error").alias("error"))
        tried = pending.select(
            F.col("original_topic").alias("topic"),
            F.col("original_partition").alias("partition"),
            F.col("original_offset").alias("offset"),
            "document_sha256",
        ).join(outcome, POSITION)
        counts = tried.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("failed")).first()
        if counts.n == 0:
            return {"tried": 0, "resolved": 0, "failed": 0}
        patch = tables.last_patch() + 1
        tables.write_part("patches", patch, changes(decoded))
        tables.write_part("repair_letters", patch, dead_letters(decoded))
        tables.write_part("repairs", patch, tried.select("*", "error.error_type", "error.error_message"))
        tables.commit_patch(patch, "repair", "dead letters", counts.n - counts.failed)
        return {"tried": counts.n, "resolved": counts.n - counts.failed, "failed": counts.failed}
    finally:
        decoded.unpersist()
        pending.unpersist()
