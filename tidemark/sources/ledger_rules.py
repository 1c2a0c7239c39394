"""Rules over run records, as data.

A rule says of the values at a path of a document what has to hold for each of them, and how
many there have to be. One evaluator walks the paths over the parsed document: records are
parsed once and never shuffled, and the rules can come from a table. A path has names and two
wild cards, ``[*]`` for the elements of an array and ``*`` for the values of an object:
``linkage.offsets[*].lag``, ``checks.*``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"^(BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"
_TYPES = {"object": "^OBJECT", "array": "^ARRAY", "text": "^STRING$", "number": _NUMBER}
MOST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """``predicate`` is one of

    object, array, text, number: the value is of that type;
    equals: it is ``argument``, a number, text or truth value of the same type;
    over, at_least: it is a number beyond, or not below, ``argument``;
    same_as, not_below: it is a number equal to, or not below, the one at the path ``argument``;
    each_once: the values are the texts of ``argument`` (comma separated), every one once.

    Fewer than ``least`` values break the rule as well; values that are null do not count.
    """

    kind: str
    name: str
    path: str
    predicate: str
    argument: object = None
    least: int = 1


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: F.try_variant_get(x, f"$.{name}", "variant")


def values_at(document: Column, path: str) -> Column:
    """The variants at a path, as an array without nulls."""
    found = F.array(document)
    for part in path.replace("[*]", ".[*]").split("."):
        if part == "[*]":
            found = F.flatten(F.transform(found, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>"))))
        elif part == "*":
            found = F.flatten(
                F.transform(
                    found,
                    lambda x: F.coalesce(F.map_values(F.try_variant_get(x, "$", "map<string,variant>")), F.array().cast("array<variant>")),
                )
            )
        elif part:
            found = F.transform(found, _field(part))
        found = F.filter(found, lambda x: x.isNotNull() & ~F.is_variant_null(x))
    return found


def _is(kind: str, x: Column) -> Column:
    return F.schema_of_variant(x).rlike(_TYPES[kind])


def _number(x: Column) -> Column:
    return F.when(_is("number", x), F.try_variant_get(x, "$", "double"))


def _holds(rule: Rule, x: Column, document: Column) -> Column:
    """Whether the value ``x`` is as the rule wants; null counts as no."""
    if rule.predicate in _TYPES:
        return _is(rule.predicate, x)
    if rule.predicate == "equals":
        if isinstance(rule.argument, bool):
            return (F.schema_of_variant(x) == "BOOLEAN") & (F.try_variant_get(x, "$", "boolean") == rule.argument)
        if isinstance(rule.argument, str):
            return _is("text", x) & (F.try_variant_get(x, "$", "string") == rule.argument)
        return _number(x) == float(rule.argument)
    if rule.predicate == "over":
        return _number(x) > float(rule.argument)
    if rule.predicate == "at_least":
        return _number(x) >= float(rule.argument)
    if rule.predicate in ("same_as", "not_below"):
        other = F.get(F.transform(values_at(document, rule.argument), _number), F.lit(0))
        return _number(x) == other if rule.predicate == "same_as" else _number(x) >= other
    raise ValueError(f"unknown predicate {rule.predicate!r}")


def broken(rule: Rule, document: Column) -> Column:
    values = values_at(document, rule.path)
    if rule.predicate == "each_once":
        texts = F.array_sort(F.transform(values, lambda x: F.try_variant_get(x, "$", "string")))
        wanted = F.array(*(F.lit(t) for t in sorted(str(rule.argument).split(","))))
        return ~texts.eqNullSafe(wanted)
    right = F.forall(values, lambda x: F.coalesce(_holds(rule, x, document), F.lit(False)))
    return ~right | (F.size(values) < rule.least)


def validate_by_rules(records: DataFrame, rules: list[Rule]) -> DataFrame:
    """(name, kind, rule) for every rule of its kind that a record breaks.

    ``records`` has (name, kind, document). A document that is no JSON object breaks the rule
    ``document``; a kind without rules breaks ``kind``.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    parsed = records.select("name", "kind", F.try_parse_json("document").alias("d"))
    document = F.col("d")
    readable = F.coalesce(_is("object", document), F.lit(False))
    by_kind: dict[str, list[Column]] = {}
    for rule in rules:
        by_kind.setdefault(rule.kind, []).append(F.when(broken(rule, document), F.lit(rule.name)))
    found = F.array(F.lit("kind"))
    for kind, names in by_kind.items():
        found = F.when(F.col("kind") == kind, F.array_compact(F.array(*names))).otherwise(found)
    found = F.when(readable, found).otherwise(F.array(F.lit("document")))
    return parsed.select("name", "kind", F.explode(F.array_distinct(found)).alias("rule"))


# Kinds of records, their fields, and what a valid record says there.
PARITY, SCHEMA, SMALL_FILES, SLO = "parity", "schema-contract", "small-file-rewrite", "slo"
RESTART, REPLAY = "broker-restart", "offset-replay"
_LINK = "offset_checkpoint_snapshot_linkage"
_CLASSES = "broker-restart,duplicate-redelivery,mis-keying,offset-replay,poison-dlq"


def _linkage(kind: str) -> list[Rule]:
    return [
        Rule(kind, "linkage.lag", f"{_LINK}.kafka_offsets[*].lag", "equals", 0),
        Rule(kind, "linkage.checkpoint", f"{_LINK}.flink_checkpoint.id", "number"),
        Rule(kind, "linkage.current", f"{_LINK}.iceberg_snapshot_ids.orders_current", "number"),
        Rule(kind, "linkage.changelog", f"{_LINK}.iceberg_snapshot_ids.orders_changelog", "number"),
    ]


def _passed(kind: str) -> list[Rule]:
    return [Rule(kind, "checks", "checks.*", "equals", True), Rule(kind, "summary", "summary.passed", "equals", True)]


RULES = [
    Rule(PARITY, "environment", "environment", "object"),
    Rule(PARITY, "parity", "parity.row_level_diff_count", "equals", 0),
    Rule(PARITY, "summary", "summary.passed", "equals", True),
    *_linkage(PARITY),
    Rule(SCHEMA, "environment", "environment", "object"),
    Rule(SCHEMA, "contracts.format", "contracts.format", "equals", "AVRO"),
    Rule(SCHEMA, "contracts.compatibility", "contracts.global_compatibility", "equals", "BACKWARD"),
    *(
        rule
        for side in ("key", "value")
        for rule in (
            Rule(SCHEMA, f"contracts.{side}", f"contracts.{side}.compatibility", "equals", "BACKWARD"),
            Rule(SCHEMA, f"contracts.{side}", f"contracts.{side}.id", "number"),
            Rule(SCHEMA, f"contracts.{side}", f"contracts.{side}.version", "number"),
            Rule(SCHEMA, f"contracts.{side}", f"contracts.{side}.schema", "object"),
        )
    ),
    Rule(SCHEMA, "rejection", "incompatible_schema_attempt.compatibility_check.is_compatible", "equals", False),
    Rule(SCHEMA, "rejection", "incompatible_schema_attempt.registration.http_status", "equals", 409),
    Rule(SCHEMA, "rejection", "incompatible_schema_attempt.registration.rejected", "equals", True),
    Rule(SCHEMA, "rejection", "incompatible_schema_attempt.latest_schema_unchanged", "equals", True),
    Rule(SCHEMA, "continuity", "flow_continuity.after_rejection.source_iceberg_diff_count", "equals", 0),
    Rule(SCHEMA, "continuity", "flow_continuity.after_rejection.post_event_visible", "equals", True),
    Rule(SCHEMA, "continuity", "flow_continuity.after_rejection.flink_checkpoint.id", "number"),
    Rule(SCHEMA, "continuity", "flow_continuity.after_rejection.kafka_offsets", "array"),
    Rule(SCHEMA, "continuity", "flow_continuity.after_rejection.kafka_offsets[*].lag", "equals", 0, least=0),
    Rule(SCHEMA, "summary", "summary.old_schema_pipeline_continued", "equals", True),
    *_passed(SCHEMA),
    *(Rule(SMALL_FILES, f"sections.{name}", name, "object") for name in ("before", "after", "rewrite_data_files", "checks", "summary")),
    *(
        Rule(SMALL_FILES, "effect", f"checks.{name}", "equals", True)
        for name in ("data_file_count_decreased", "manifest_count_decreased", "median_file_size_increased", "planning_latency_decreased")
    ),
    *(
        rule
        for kind in (RESTART, REPLAY)
        for rule in (
            Rule(kind, "identity", "phase", "equals", "B3"),
            Rule(kind, "identity", "failure_class", "equals", kind),
            Rule(kind, "environment", "environment", "object"),
            Rule(kind, "diff", "snapshot_diff_count", "equals", 0),
            Rule(kind, "diff", "reconciliation.snapshot_diff_count", "equals", 0),
            *_linkage(kind),
            *_passed(kind),
        )
    ),
    Rule(RESTART, "restart", "fault.container_killed.Running", "equals", False),
    Rule(RESTART, "restart", "fault.container_after.Running", "equals", True),
    Rule(RESTART, "restart", "summary.pipeline_resumed", "equals", True),
    Rule(REPLAY, "rebuilds", "summary.offset_zero_diff_count", "equals", 0),
    Rule(REPLAY, "rebuilds", "summary.timestamp_diff_count", "equals", 0),
    Rule(REPLAY, "rebuilds", "timestamp_replay.resolved_partition_offsets", "array"),
    Rule(SLO, "identity", "phase", "equals", "B4"),
    Rule(SLO, "environment", "environment", "object"),
    Rule(SLO, "workload", "scenario.events", "equals", 100_000),
    Rule(SLO, "workload", "scenario.seed", "number"),
    Rule(SLO, "observability", "observability.time_series[*]", "object", least=2),
    Rule(SLO, "observability", "observability.summary.lag_sample_count", "over", 0),
    Rule(SLO, "observability", "observability.summary.prometheus_lag_sample_count", "over", 0),
    Rule(SLO, "observability", "observability.summary.debezium_sample_count", "over", 0),
    Rule(SLO, "observability", "observability.summary.max_consumer_group_lag", "over", 0),
    Rule(SLO, "observability", "observability.summary.debezium_metric_names[*]", "text", least=2),
    Rule(SLO, "throughput", "benchmark.throughput.end_to_end_rows_per_second", "over", 0),
    Rule(SLO, "freshness", "benchmark.freshness.sample_count", "equals", 100_000),
    Rule(SLO, "freshness", "benchmark.freshness.p50_ms", "at_least", 0),
    Rule(SLO, "freshness", "benchmark.freshness.p95_ms", "not_below", "benchmark.freshness.p50_ms"),
    Rule(SLO, "recoveries", "recovery_measurements[*].failure_class", "each_once", _CLASSES),
    Rule(SLO, "recoveries", "recovery_measurements[*].recovery_seconds", "over", 0, least=5),
    Rule(SLO, "recoveries", "recovery_measurements[*].snapshot_diff_count", "equals", 0, least=5),
    Rule(SLO, "recoveries", "recovery_measurements[*].checks.*", "equals", True, least=5),
    Rule(SLO, "diff", "snapshot_diff_count", "equals", 0),
    *_linkage(SLO),
    *_passed(SLO),
]
