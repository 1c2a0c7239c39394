"""Envelope decoding: log records to row images or dead letters.

A record decodes as a whole or not at all. ``decode`` keeps one output row per
record with an array of images; ``changes`` and ``dead_letters`` split it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import (
    INTEGER_VARIANTS,
    NUMBER_VARIANTS,
    TIMESTAMP_TEXT,
    iso_utc,
)
from tidemark.schemas import (
    CHANGELOG_COLUMNS,
    DEAD_LETTER,
    DEAD_LETTER_VERSION,
    DELETE,
    INSERT,
    MICROS_FROM,
    ORDER_COLUMNS,
    POSITION_COLUMNS,
    UPDATE_AFTER,
    UPDATE_BEFORE,
)

_ROW_DDL = (
    "order_id BIGINT, business_key STRING, event_id BIGINT, customer_id BIGINT, "
    "status STRING, amount_cents BIGINT, updated_at VARIANT, seed BIGINT"
)
_ENVELOPE_DDL = (
    f"before STRUCT<{_ROW_DDL}>, after STRUCT<{_ROW_DDL}>, op STRING, ts_ms BIGINT, _bad STRING"
)
_LONGS = ("order_id", "event_id", "customer_id", "amount_cents", "seed")
_TEXTS = ("business_key", "status")
# Text a non-string token could have produced; only such values are re-checked.
_MAYBE_NOT_TEXT = r"^(-?[0-9]|\{|\[|true$|false$)"

_POSITION = POSITION_COLUMNS[:3] + ["timestamp_ms"]


def skip_tombstones(log: DataFrame) -> DataFrame:
    return log.where(F.col("value").isNotNull())


# The decoder is written as SQL text: the expressions are many, and text reaches
# the JVM in one call per projection, which counts in short micro-batches.
_KIND = "schema_of_variant({})"
_INTEGER = f"rlike({_KIND}, r'{INTEGER_VARIANTS}')"
_NUMBER = f"rlike({_KIND}, r'{NUMBER_VARIANTS}')"


def _long(v: str) -> str:
    """Any number to a long, fraction cut off; text, booleans and overflow give null."""
    double = f"try_variant_get({v}, '$', 'double')"
    return (
        f"CASE WHEN {_INTEGER.format(v)} THEN try_variant_get({v}, '$', 'bigint') "
        f"WHEN {_NUMBER.format(v)} AND abs({double}) < 9.2e18 THEN try_cast({double} AS BIGINT) END"
    )


def _timestamp(v: str) -> str:
    """A number or a text to UTC wall time; null if it is neither."""
    n = f"try_variant_get({v}, '$', 'bigint')"
    text = f"try_variant_get({v}, '$', 'string')"

    def epoch(x: str) -> str:
        return (
            f"CAST(CASE WHEN abs({x}) < {MICROS_FROM} THEN timestamp_millis({x}) "
            f"ELSE timestamp_micros({x}) END AS TIMESTAMP_NTZ)"
        )

    return (
        f"CASE WHEN {_KIND.format(v)} = 'BIGINT' THEN {epoch(n)} "
        f"WHEN {_KIND.format(v)} = 'STRING' THEN "
        f"CASE WHEN rlike({text}, r'{TIMESTAMP_TEXT}') THEN try_cast({text} AS TIMESTAMP_NTZ) END "
        f"WHEN {_NUMBER.format(v)} THEN {epoch('(' + _long(v) + ')')} END"
    )


def _second_look(side: str, names: tuple[str, ...], check: str) -> str:
    """``check`` over the named fields of the record's VARIANT form, where there is one."""
    fields = ", ".join(f"try_variant_get(_loose, '$.{side}.{n}', 'variant')" for n in names)
    return f"CASE WHEN _loose IS NOT NULL THEN transform(array({fields}), v -> {check}) END"


def _row_image(side: str, index: int) -> str:
    """Typed columns of one row image; null marks a missing or ill-typed field.

    The typed JSON parse serves well-formed records. Where it reports a mismatch
    the record was parsed again as VARIANT (``_loose``), which can tell ``12.0``
    (a number, accepted) from ``"12"`` (text, rejected).
    """
    fields = []
    for name in ORDER_COLUMNS:
        value = f"_e.{side}.{name}"
        if name in _LONGS:
            value = f"coalesce({value}, _{side}_longs[{_LONGS.index(name)}])"
            value = f"try_cast({value} AS INT)" if name == "seed" else value
        elif name in _TEXTS:
            value = f"CASE WHEN coalesce(_{side}_texts[{_TEXTS.index(name)}], true) THEN {value} END"
        else:
            value = f"_ts[{index}]"
        fields.append(f"'{name}', {value}")
    return f"CASE WHEN _e.{side} IS NOT NULL THEN named_struct({', '.join(fields)}) END AS _{side}"


def _gaps(side: str) -> str:
    """Names of the fields a row image lacks, comma separated."""
    names = ", ".join(f"CASE WHEN _{side}.{n} IS NULL THEN '{n}' END" for n in ORDER_COLUMNS)
    return f"concat_ws(',', {names}) AS _{side}_gaps"


def _row_problem(side: str) -> str:
    return (
        f"CASE WHEN _{side} IS NULL THEN 'Missing row payload in {side}' "
        f"WHEN _{side}_gaps <> '' THEN "
        f"concat('Missing or ill-typed fields in {side}: ', _{side}_gaps) END"
    )


def decode(log: DataFrame, tombstones: bool = False) -> DataFrame:
    """One row per outcome: a row image or a decoding error, never both.

    With ``tombstones`` they keep a row with neither, for their position.

    The outcomes leave one generator, so filters on them stay behind it and
    each value is parsed once however the result is split.
    """
    text = "CAST(value AS STRING)"
    suspect = " OR ".join(
        ["_e._bad IS NOT NULL"]
        + [
            f"coalesce(rlike(_e.{side}.{name}, r'{_MAYBE_NOT_TEXT}'), false)"
            for side in ("before", "after")
            for name in _TEXTS
        ]
    )
    passed = [*_POSITION, "key", "value"]
    ops = {
        "c": (INSERT, "insert"),
        "r": (INSERT, "snapshot"),
        "u": (UPDATE_BEFORE, "update_before"),
        "d": (DELETE, "delete"),
    }
    kinds = " ".join(f"WHEN '{op}' THEN '{kind}'" for op, (kind, _) in ops.items())
    names = " ".join(f"WHEN '{op}' THEN '{name}'" for op, (_, name) in ops.items())
    no_error = "CAST(NULL AS STRUCT<error_type: STRING, error_message: STRING>)"
    return (
        (log if tombstones else skip_tombstones(log))
        .selectExpr(
            *passed,
            f"from_json({text}, '{_ENVELOPE_DDL}', "
            "map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '_bad')) AS _e",
        )
        .selectExpr(
            *passed, "_e", f"CASE WHEN {suspect} THEN try_parse_json({text}) END AS _loose"
        )
        .selectExpr(
            *passed,
            "_e",
            "_e._bad IS NOT NULL AND (_loose IS NULL OR "
            f"NOT startswith({_KIND.format('_loose')}, 'OBJECT')) AS _broken",
            "try_variant_get(_loose, '$.ts_ms', 'variant') AS _ts_loose",
            *[
                f"{_second_look(side, fields, check)} AS _{side}_{what}"
                for side in ("before", "after")
                for what, fields, check in (
                    ("longs", _LONGS, _long("v")),
                    ("texts", _TEXTS, f"{_KIND.format('v')} = 'STRING'"),
                )
            ],
            "transform(array(_e.before.updated_at, _e.after.updated_at), "
            f"v -> {_timestamp('v')}) AS _ts",
        )
        .selectExpr(
            *passed,
            "_e.op AS _op",
            "_broken",
            f"coalesce(_e.ts_ms, {_long('_ts_loose')}) AS source_ts_ms",
            "_ts_loose IS NOT NULL AND NOT is_variant_null(_ts_loose) AS _has_ts",
            _row_image("before", 0),
            _row_image("after", 1),
        )
        .selectExpr("*", _gaps("before"), _gaps("after"))
        .selectExpr(
            "*",
            f"coalesce(CASE WHEN _op IN ('u', 'd') THEN {_row_problem('before')} END, "
            f"CASE WHEN _op <> 'd' THEN {_row_problem('after')} END) AS _problem",
        )
        .selectExpr(
            "*",
            "CASE WHEN value IS NULL THEN NULL WHEN _broken THEN 'MalformedEnvelope' "
            "WHEN _has_ts AND source_ts_ms IS NULL THEN 'InvalidField' "
            "WHEN NOT coalesce(_op IN ('c', 'r', 'u', 'd'), false) THEN 'UnsupportedOperation' "
            "WHEN _problem IS NOT NULL THEN 'InvalidRow' END AS _kind",
        )
        .selectExpr(
            *passed,
            "source_ts_ms",
            f"""inline(array(
                named_struct(
                    'image', CASE WHEN _kind IS NULL AND value IS NOT NULL THEN named_struct(
                        'image_seq', 0,
                        'cdc_row_kind', CASE _op {kinds} END,
                        'cdc_operation', CASE _op {names} END,
                        'row', CASE WHEN _op IN ('u', 'd') THEN _before ELSE _after END) END,
                    'error', CASE WHEN _kind IS NOT NULL THEN named_struct(
                        'error_type', _kind,
                        'error_message', CASE _kind
                            WHEN 'MalformedEnvelope' THEN 'Value is not a JSON object'
                            WHEN 'InvalidField' THEN 'Expected numeric value in ts_ms'
                            WHEN 'UnsupportedOperation'
                                THEN concat('Unsupported operation: ', coalesce(_op, 'null'))
                            ELSE _problem END) END),
                named_struct(
                    'image', CASE WHEN _kind IS NULL AND value IS NOT NULL AND _op = 'u' THEN named_struct(
                        'image_seq', 1, 'cdc_row_kind', '{UPDATE_AFTER}',
                        'cdc_operation', 'update_after', 'row', _after) END,
                    'error', {no_error})))""",
        )
        .where("image IS NOT NULL OR error IS NOT NULL" + " OR value IS NULL" * tombstones)
    )


def changes(decoded: DataFrame) -> DataFrame:
    """Row images of the decodable records, one row each."""
    return valid_records(decoded).select(
        *_POSITION,
        "image.image_seq",
        "image.cdc_row_kind",
        "image.cdc_operation",
        *[F.col(f"image.row.{c}").alias(c) for c in ORDER_COLUMNS],
        "source_ts_ms",
    )


def valid_records(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("image").isNotNull())


def poison_records(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("error").isNotNull())


def dead_letters(decoded: DataFrame, quarantined_at: Column | None = None) -> DataFrame:
    """The quarantine document of every record that could not be decoded."""
    at = quarantined_at if quarantined_at is not None else iso_utc(F.current_timestamp())
    return poison_records(decoded).select(
        F.lit(DEAD_LETTER_VERSION).alias("dlq_schema_version"),
        at.alias("quarantined_at"),
        F.col("topic").alias("original_topic"),
        F.col("partition").alias("original_partition"),
        F.col("offset").alias("original_offset"),
        F.col("timestamp_ms").alias("original_timestamp_ms"),
        F.base64("key").alias("original_key_base64"),
        F.base64("value").alias("original_value_base64"),
        "error.error_type",
        "error.error_message",
    )


def dead_letter_json(letters: DataFrame) -> DataFrame:
    """Wire form: one JSON text per dead letter, null key and value written out."""
    return letters.select(
        F.to_json(
            F.struct(*DEAD_LETTER.fieldNames()), {"ignoreNullFields": "false"}
        ).alias("value")
    )


def drop_update_before(images: DataFrame) -> DataFrame:
    """The images the current table applies."""
    return images.where(F.col("cdc_row_kind") != UPDATE_BEFORE)


def to_current_rows(images: DataFrame) -> DataFrame:
    return drop_update_before(images).select(*ORDER_COLUMNS, "cdc_row_kind")


def to_changelog_rows(images: DataFrame) -> DataFrame:
    return images.select(*CHANGELOG_COLUMNS)
