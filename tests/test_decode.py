from __future__ import annotations

import json

import pytest
from helpers import TS, envelope, log, order, rows, wire
from pyspark.sql import functions as F

from tidemark.functions.columns import wire_schema_id, with_wire_header
from tidemark.operators.decode import (
    changes,
    dead_letter_json,
    dead_letters,
    decode,
    drop_update_before,
    to_changelog_rows,
    to_current_rows,
)
from tidemark.operators.encode import snapshot_records
from tidemark.schemas import CHANGELOG_COLUMNS, ORDER_COLUMNS


def outcome(spark, value):
    found = decode(log(spark, value)).collect()
    return [(r.image.cdc_row_kind if r.image else None, r.error.error_type if r.error else None) for r in found]


def test_operations_map_to_row_kinds(spark):
    a, b = order(1, 1), order(1, 2, "paid")
    values = [envelope("r", after=a), envelope("c", after=a), envelope("u", a, b), envelope("d", before=b)]
    got = rows(changes(decode(log(spark, *values))), "offset", "image_seq", "cdc_row_kind", "cdc_operation", "event_id")
    assert got == [
        (0, 0, "+I", "snapshot", 1),
        (1, 0, "+I", "insert", 1),
        (2, 0, "-U", "update_before", 1),
        (2, 1, "+U", "update_after", 2),
        (3, 0, "-D", "delete", 2),
    ]


def test_tombstones_vanish(spark):
    assert outcome(spark, None) == []


@pytest.mark.parametrize(
    ("value", "error"),
    [
        ("not json", "MalformedEnvelope"),
        ("[1]", "MalformedEnvelope"),
        (envelope("x", after=order(1)), "UnsupportedOperation"),
        (b'{"after":{}}', "UnsupportedOperation"),
        (envelope("c"), "InvalidRow"),
        (envelope("d", after=order(1)), "InvalidRow"),
        # an update with a good before image and no after image yields no image at all
        (envelope("u", before=order(1)), "InvalidRow"),
        (envelope("c", after=order(1), ts_ms="x"), "InvalidField"),
    ],
)
def test_bad_records_are_quarantined_whole(spark, value, error):
    assert outcome(spark, value) == [(None, error)]


@pytest.mark.parametrize(
    ("field", "value", "accepted"),
    [
        ("order_id", 12.75, True),
        ("order_id", "12", False),
        ("order_id", True, False),
        ("order_id", 10**20, False),
        ("seed", 2**40, False),
        ("status", 5, False),
        ("status", "5", True),
        ("status", None, False),
        ("updated_at", "2026-01-01 00:00:00", True),
        ("updated_at", "2026-01-01T00:00:00.000Z", True),
        ("updated_at", 1767225600000000, True),
        ("updated_at", "1767225600000", False),
        ("updated_at", "2026-01-01", False),
    ],
)
def test_field_strictness(spark, field, value, accepted):
    row = {**wire(order(12)), field: value}
    text = json.dumps({"op": "c", "before": None, "after": row, "ts_ms": None})
    found = changes(decode(log(spark, text))).collect()
    assert len(found) == accepted
    if accepted:
        assert found[0].order_id == 12 and found[0].updated_at == TS


def test_missing_field_and_extra_field(spark):
    row = wire(order(3))
    extra = json.dumps({"op": "c", "after": {**row, "more": [1]}, "ts_ms": 1})
    del row["seed"]
    short = json.dumps({"op": "c", "after": row, "ts_ms": 1})
    assert outcome(spark, extra) == [("+I", None)]
    letter = dead_letters(decode(log(spark, short))).first()
    assert letter.error_message == "Missing or ill-typed fields in after: seed"


def test_dead_letter_keeps_bytes_and_nulls(spark):
    source = log(spark, b"\x00\xff broken").withColumn("key", F.lit(None).cast("binary"))
    doc = json.loads(dead_letter_json(dead_letters(decode(source))).first().value)
    assert doc["original_key_base64"] is None and doc["dlq_schema_version"] == 1
    letter = dead_letters(decode(source)).select(F.unbase64("original_value_base64").alias("v")).first()
    assert bytes(letter.v) == b"\x00\xff broken"


def test_projections(spark):
    decoded = changes(decode(log(spark, envelope("u", order(1), order(1, 2)))))
    assert to_changelog_rows(decoded).columns == CHANGELOG_COLUMNS
    assert to_current_rows(decoded).count() == drop_update_before(decoded).count() == 1


def test_snapshot_records_round_trip(spark):
    from helpers import orders

    table = orders(spark, order(1), order(2))
    back = changes(decode(snapshot_records(table, "t", F.lit(9))))
    assert rows(back, *ORDER_COLUMNS) == rows(table)
    assert {r.offset for r in back.collect()} == {-1}


def test_wire_header(spark):
    df = spark.range(1).select(
        wire_schema_id(with_wire_header(F.lit(258), F.lit(b"x"))).alias("ok"),
        wire_schema_id(F.lit(b"\x01\x00\x00\x00\x01")).alias("magic"),
        wire_schema_id(F.lit(b"\x00\x00")).alias("short"),
    )
    assert tuple(df.first()) == (258, None, None)
