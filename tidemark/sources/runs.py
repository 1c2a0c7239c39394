"""Run ledger: append-only, provenance-stamped run records."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import RUN_FIELDS


def write_run_record(
    spark: SparkSession, path: str, provenance: Mapping[str, object], payload: Mapping[str, object]
) -> None:
    """Write one record as a JSON document; an existing record is never replaced."""
    missing = [f for f in RUN_FIELDS if provenance.get(f) is None]
    if missing:
        raise ValueError(f"provenance lacks {', '.join(missing)}")
    text = json.dumps({**provenance, **payload}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("error").text(path)


def read_run_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Run documents below ``path`` as (name, document)."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("name"),
        F.col("value").alias("document"),
    )


def run_index(ledger: DataFrame) -> DataFrame:
    """Name, phase and provenance of every record."""
    doc = F.from_json(
        "document",
        "phase STRING, run_id STRING, git_sha STRING, started_at STRING, finished_at STRING, "
        "command STRING, logs STRING",
    )
    return ledger.select("name", doc.alias("d")).select("name", "d.*")


_RULE_DDL = (
    "phase STRING, failure_class STRING, run_id STRING, git_sha STRING, started_at STRING, "
    "finished_at STRING, stack_versions VARIANT, command STRING, logs STRING, "
    "snapshot_diff_count BIGINT, environment VARIANT, checks VARIANT, "
    "summary STRUCT<passed BOOLEAN>, "
    "offset_checkpoint_snapshot_linkage STRUCT<"
    "kafka_offsets ARRAY<STRUCT<partition INT, lag BIGINT>>, checkpoint STRUCT<id BIGINT>, "
    "snapshot_ids STRUCT<orders_current BIGINT, orders_changelog BIGINT>>, "
    "duplicates STRUCT<occurrences BIGINT, expected BIGINT>, "
    "miskey STRUCT<violations BIGINT, would_corrupt BOOLEAN>, "
    "dead_letters BIGINT, results ARRAY<STRUCT<failure_class STRING, snapshot_diff_count BIGINT>>"
)
DRILLS = ["duplicate-redelivery", "mis-keying", "poison-dlq", "offset-replay", "broker-restart"]


def _rules() -> list[tuple[str, Column]]:
    """(rule, violated) pairs over the parsed document ``d``."""
    d = lambda path: F.col(f"d.{path}")
    link = "offset_checkpoint_snapshot_linkage"
    drill = d("failure_class").isin(DRILLS)
    suite = d("results").isNotNull()
    no = F.lit(False)
    bad_link = (
        d(link).isNull()
        | (F.coalesce(F.size(d(f"{link}.kafka_offsets")), F.lit(0)) <= 0)
        | F.exists(d(f"{link}.kafka_offsets"), lambda o: F.coalesce(o["lag"] != 0, F.lit(True)))
        | d(f"{link}.checkpoint.id").isNull()
        | d(f"{link}.snapshot_ids.orders_current").isNull()
        | d(f"{link}.snapshot_ids.orders_changelog").isNull()
    )
    # only a boolean true passes: no null, no text
    is_true = lambda x: (F.schema_of_variant(x) == "BOOLEAN") & F.try_variant_get(x, "$", "boolean")
    false_check = F.exists(
        F.map_values(F.try_variant_get(d("checks"), "$", "map<string,variant>")),
        lambda x: ~F.coalesce(is_true(x), F.lit(False)),
    )
    is_class = lambda name: F.coalesce(d("failure_class") == name, no)
    return [
        *[
            (f"provenance.{f}", d(f).isNull())
            for f in RUN_FIELDS
            if f != "stack_versions"
        ],
        (
            "provenance.stack_versions",
            ~F.coalesce(F.schema_of_variant(d("stack_versions")).startswith("OBJECT"), no),
        ),
        ("suite.results", suite & (F.size(d("results")) == 0)),
        (
            "suite.result_fields",
            suite
            & F.exists(
                F.coalesce(d("results"), F.array()),
                lambda r: r["failure_class"].isNull() | r["snapshot_diff_count"].isNull(),
            ),
        ),
        ("drill.environment", drill & d("environment").isNull()),
        ("drill.diff_zero", drill & F.coalesce(d("snapshot_diff_count") != 0, F.lit(True))),
        ("drill.linkage", drill & F.coalesce(bad_link, F.lit(True))),
        (
            "drill.checks",
            drill
            & (d("checks").isNull() | F.coalesce(false_check, F.lit(False)) | ~F.coalesce(d("summary.passed"), no)),
        ),
        (
            "redelivery.exact_duplicates",
            is_class("duplicate-redelivery")
            & ~F.coalesce(
                (d("duplicates.occurrences") > 0)
                & (d("duplicates.occurrences") == d("duplicates.expected")),
                no,
            ),
        ),
        (
            "miskey.exposed",
            is_class("mis-keying")
            & ~F.coalesce((d("miskey.violations") >= 1) & d("miskey.would_corrupt"), no),
        ),
        ("poison.one_dead_letter", is_class("poison-dlq") & ~F.coalesce(d("dead_letters") == 1, no)),
    ]


def validate_ledger(ledger: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """One row per (name, rule) a record breaks; no rows means a valid ledger.

    ``logs`` (a ``path`` column) lists the log files that exist.
    """
    parsed = ledger.select("name", F.from_json("document", _RULE_DDL).alias("d"))
    broken = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in _rules()])
    rows = parsed.select("name", F.explode(F.array_compact(broken)).alias("rule"))
    if logs is None:
        return rows
    missing = (
        parsed.where(F.col("d.logs").isNotNull())
        .select("name", F.col("d.logs").alias("path"))
        .join(logs.select("path"), "path", "left_anti")
    )
    return rows.unionByName(missing.select("name", F.lit("logs.exist").alias("rule")))
