"""Duplicate, ordering, key and quarantine audits, and check suites."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import blocked, id_runs
from tidemark.functions.columns import floor_div
from tidemark.schemas import DEAD_LETTER


# -- duplicates -----------------------------------------------------------------


def duplicate_event_ids(changelog: DataFrame) -> DataFrame:
    """Event ids the changelog holds more than once.

    Exact for insert-only loads; update and delete images repeat the id of the
    image before them. ``record_duplicates`` has no such limit.
    """
    return (
        changelog.groupBy("event_id")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .where(F.col("occurrences") > 1)
    )


def record_duplicates(images: DataFrame) -> DataFrame:
    """Images delivered more than once, by log position."""
    return (
        images.groupBy("topic", "partition", "offset", "image_seq")
        .agg(F.count(F.lit(1)).alias("deliveries"))
        .where(F.col("deliveries") > 1)
    )


def duplicate_counts(changelog: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows, distinct ids, ids with copies and surplus copies, in two aggregates."""
    per_id = changelog.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("changelog_rows"),
        F.count(F.lit(1)).alias("distinct_ids"),
        F.count_if(F.col("n") > 1).alias("duplicate_ids"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_occurrences"),
    )


def id_set_counts(sides: Mapping[str, DataFrame], key: str = "event_id") -> DataFrame:
    """Per side the number of distinct ids it holds and how many other sides lack any of them.

    One row: ``<side>_ids`` for each side and ``common_ids`` held by all of them.
    Sets are equal when all these numbers are.
    """
    tagged = None
    for i, df in enumerate(sides.values()):
        part = df.select(F.col(key).alias("__id"), F.lit(1 << i).alias("__bit"))
        tagged = part if tagged is None else tagged.unionAll(part)
    held = tagged.groupBy("__id").agg(F.bit_or("__bit").alias("__sides"))
    everyone = (1 << len(sides)) - 1
    return held.agg(
        *[
            F.count_if(F.col("__sides").bitwiseAND(1 << i) != 0).alias(f"{name}_ids")
            for i, name in enumerate(sides)
        ],
        F.count_if(F.col("__sides") == everyone).alias("common_ids"),
    )


def event_id_audit(
    source: DataFrame, current: DataFrame, changelog: DataFrame, expected_changelog_rows: Column | None = None
) -> DataFrame:
    """Current id sets against each other, and changelog totals, in one row.

    The two one-row parts meet through a tagged union, not a join.
    """
    sets = id_set_counts({"source": source, "current": current}).select(
        "source_ids", "current_ids", "common_ids"
    )
    counts = duplicate_counts(changelog)
    joined = (
        sets.unionByName(counts, allowMissingColumns=True)
        .agg(*[F.max(c).alias(c) for c in [*sets.columns, *counts.columns]])
    )
    match = (F.col("source_ids") == F.col("common_ids")) & (F.col("current_ids") == F.col("common_ids"))
    out = joined.withColumn("current_event_ids_match", match)
    if expected_changelog_rows is not None:
        out = out.withColumn("changelog_count_match", F.col("changelog_rows") == expected_changelog_rows)
    return out


def expected_event_ids(
    source: DataFrame,
    current: DataFrame,
    changelog: DataFrame,
    expected_current: DataFrame,
    expected_changelog: DataFrame,
    expected_changelog_rows: DataFrame,
    key: str = "event_id",
) -> DataFrame:
    """Source, current and changelog id sets against expected ones, and the changelog's row count.

    The expected sets are runs (first, last) and are never written out; ``expected_changelog_rows``
    is one row with ``n``. One row: what each set lacks and has too much, and ``consistent``.
    """
    wanted_current = id_runs.cut_runs(expected_current)
    wanted_changelog = id_runs.cut_runs(expected_changelog)
    row = None
    for name, ids, wanted in (
        ("source", source, wanted_current),
        ("current", current, wanted_current),
        ("changelog", changelog, wanted_changelog),
    ):
        part = id_runs.compare_runs(id_runs.runs_of(ids, key), wanted).select(
            F.col("actual_ids").alias(f"{name}_ids"),
            F.col("missing_ids").alias(f"{name}_missing"),
            F.col("unexpected_ids").alias(f"{name}_unexpected"),
        )
        row = part if row is None else row.unionByName(part, allowMissingColumns=True)
    row = row.unionByName(changelog.agg(F.count(F.lit(1)).alias("changelog_rows")), allowMissingColumns=True)
    row = row.unionByName(expected_changelog_rows.select(F.col("n").alias("expected_rows")), allowMissingColumns=True)
    row = row.agg(*[F.max(c).alias(c) for c in row.columns])

    def equal(*names: str) -> Column:
        return reduce(and_, [(F.col(f"{n}_missing") == 0) & (F.col(f"{n}_unexpected") == 0) for n in names])

    return row.select(
        "*",
        equal("source", "current").alias("current_sets_match"),
        equal("changelog").alias("changelog_set_match"),
        F.coalesce(F.col("changelog_rows") == F.col("expected_rows"), F.lit(False)).alias("changelog_count_match"),
    ).withColumn("consistent", F.col("current_sets_match") & F.col("changelog_set_match") & F.col("changelog_count_match"))


def replay_targets(measured: DataFrame) -> DataFrame:
    """``measured`` with what a full replay must lead to.

    It has ``changelog_rows``, ``duplicate_occurrences`` and ``replayed``: every replayed image
    is one more changelog row and one more surplus copy. A negative count fails the job.
    """
    replayed = F.when(
        F.least("changelog_rows", "duplicate_occurrences", "replayed") >= 0, F.col("replayed")
    ).otherwise(F.raise_error(F.lit("a replay cannot start from negative counts")).cast("bigint"))
    return measured.select(
        "*",
        (F.col("changelog_rows") + replayed).alias("expected_changelog_rows"),
        (F.col("duplicate_occurrences") + replayed).alias("expected_duplicate_occurrences"),
    )


def redelivery_audit(deliveries: DataFrame, current: DataFrame, times: int = 2) -> DataFrame:
    """Every record image delivered exactly ``times``; keys of the current table unique.

    ``deliveries`` holds one row per delivered image, ``current`` the live rows.
    """
    images = (
        deliveries.groupBy("topic", "partition", "offset", "image_seq")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.count(F.lit(1)).alias("images"),
            F.sum("n").alias("deliveries"),
            F.sum(F.col("n") - 1).alias("duplicate_occurrences"),
            F.count_if(F.col("n") != times).alias("images_off_target"),
        )
    )
    keys = (
        current.groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count(F.lit(1)).alias("current_keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"))
    )
    columns = [*images.columns, *keys.columns]
    return (
        images.unionByName(keys, allowMissingColumns=True)
        .agg(*[F.max(c).alias(c) for c in columns])
        .withColumn(
            "passed", (F.col("images_off_target") == 0) & (F.col("repeated_keys") == 0)
        )
    )


# -- ordering and keys ----------------------------------------------------------


def _stepped(
    rows: DataFrame, key: str, value: str, order: list[str], block: Column, out: str
) -> DataFrame:
    return blocked.lag(rows, [key], order, block, value, out)


def monotonic_violations(
    images: DataFrame,
    order: list[str],
    block: Column,
    key: str = "order_id",
    value: str = "event_id",
) -> DataFrame:
    """Per key: rows and adjacent pairs whose value does not rise.

    Give it images of kind +I and +U only; the others repeat the id before them.
    """
    stepped = _stepped(images, key, value, order, block, "__prev")
    return stepped.groupBy(key).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col(value) <= F.col("__prev")).alias("violations"),
    )


def miskey_audit(probe: DataFrame, block_ms: int = 60_000) -> DataFrame:
    """Per primary key: keying, spread, order and what arrival order would leave behind.

    ``probe`` has (key_order_id, order_id, event_id, partition, offset, timestamp_ms).
    """
    order = ["timestamp_ms", "partition", "offset"]
    stepped = blocked.running(
        probe,
        ["order_id"],
        order,
        floor_div(F.col("timestamp_ms"), block_ms),
        [
            blocked.Running("__prev_event", "lag", "event_id"),
            blocked.Running("__prev_offset", "lag", "offset"),
        ],
    )
    arrival = F.struct(*order)
    return stepped.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("key_order_id") != F.col("order_id")).alias("mismatched_keys"),
        # a key seen on one partition has equal ends; no set of partitions is kept
        (F.min("partition") != F.max("partition")).alias("spans_partitions"),
        F.count_if(F.col("event_id") <= F.col("__prev_event")).alias("order_violations"),
        F.count_if(F.col("offset") <= F.col("__prev_offset")).alias("offset_violations"),
        F.max_by("event_id", arrival).alias("arrival_final_event_id"),
        F.max("event_id").alias("canonical_final_event_id"),
    ).withColumn(
        "would_corrupt", F.col("arrival_final_event_id") != F.col("canonical_final_event_id")
    ).withColumn(
        "disposition",
        F.when(
            (F.col("mismatched_keys") > 0) | (F.col("order_violations") > 0), F.lit("reject")
        ).otherwise(F.lit("admit")),
    )


def partitions_per_key(probe: DataFrame) -> DataFrame:
    """Number of partitions the records of a primary key landed on."""
    return (
        probe.groupBy("order_id", "partition")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("partitions"), F.sum("n").alias("records"))
    )


def admission_gate(probe: DataFrame, audit: DataFrame) -> DataFrame:
    """Every probe record with ``admitted``: keys with a violation stay isolated as a whole."""
    verdict = audit.select("order_id", (F.col("disposition") == "admit").alias("admitted"))
    block = F.struct("partition", floor_div(F.col("offset"), 65_536))
    return blocked.join_per_key(probe, verdict, ["order_id"], block)


# -- quarantine -----------------------------------------------------------------


def dlq_audit(letters: DataFrame, log: DataFrame, expected: int | None = None) -> DataFrame:
    """Distinct dead letters, completeness of their metadata, and byte equality with the log.

    Every field but the key must be there. With ``expected`` also whether the number is right.
    """
    required = [F.col(f).isNotNull() for f in DEAD_LETTER.fieldNames() if f != "original_key_base64"]
    position = ["topic", "partition", "offset"]
    distinct = letters.select(
        F.col("original_topic").alias("topic"),
        F.col("original_partition").alias("partition"),
        F.col("original_offset").alias("offset"),
        F.unbase64("original_value_base64").alias("__kept"),
        reduce(and_, required).alias("__named"),
    ).dropDuplicates(position)
    # only the payloads of dead positions meet the letters
    dead = log.select(*position, "value").join(distinct.select(*position), position, "left_semi")
    out = distinct.join(dead, position, "left").agg(
        F.count(F.lit(1)).alias("dead_letters"),
        F.coalesce(F.every("__named"), F.lit(True)).alias("metadata_complete"),
        F.coalesce(F.every(F.col("__kept").eqNullSafe(F.col("value"))), F.lit(True)).alias(
            "bytes_preserved"
        ),
    )
    return out if expected is None else out.withColumn("count_match", F.col("dead_letters") == expected)


# -- check suites ---------------------------------------------------------------


def checks_of(row: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(check_name, passed) rows out of a one-row measurement; null counts as failed."""
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("check_name"), F.coalesce(c, F.lit(False)).alias("passed"))
            for n, c in checks.items()
        ]
    )
    return row.select(F.inline(pairs))


def check_suite(checks: DataFrame) -> DataFrame:
    """One row: all passed, and the names of failed checks (a name occurs once per suite)."""
    failed = F.when(~F.col("passed"), F.col("check_name"))
    return checks.agg(
        F.every("passed").alias("passed"),
        F.count(F.lit(1)).alias("checks"),
        F.array_join(F.array_sort(F.collect_set(failed)), ",").alias("failed"),
    )


def suite_summary(runs: DataFrame) -> DataFrame:
    """Roll-up over runs: (failure_class, passed, snapshot_diff_count, audit_consistent, error)."""
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        (F.count("error") == 0).alias("passed"),
        F.every(F.col("passed") & F.coalesce(F.col("snapshot_diff_count") == 0, F.lit(False))).alias(
            "all_snapshot_diffs_zero"
        ),
        F.every(F.col("passed") & F.coalesce("audit_consistent", F.lit(False))).alias(
            "all_event_id_audits_consistent"
        ),
        F.sum("snapshot_diff_count").alias("total_diff"),
        F.count("error").alias("errors"),
    )
