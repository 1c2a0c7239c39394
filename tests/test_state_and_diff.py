from __future__ import annotations

import random

import pytest
from helpers import envelope, image, images, log, order, orders, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.columns import text_row
from tidemark.functions.digests import multiset_digest, ordered_digest
from tidemark.operators import diff
from tidemark.operators.decode import changes, decode
from tidemark.operators.replay import open_dead_letters, rebuild, rebuild_from_timestamp, timestamp_coverage
from tidemark.operators.state import current_state, current_state_as_of, latest_per_key
from tidemark.schemas import ORDER_COLUMNS

A, B, C = order(1, 1), order(1, 2, "paid"), order(2, 3)
HISTORY = [
    image(0, "+I", A),
    image(1, "-U", A),
    image(1, "+U", B, seq=1),
    image(2, "+I", C),
    image(3, "-D", C),
]


def test_smoke_scenario(spark):
    """Two inserts, two updates, one delete: one row, seven images."""
    a1, a2, b1, b2 = order(1201), order(1201, 2, "paid"), order(1202, 3), order(1202, 4, "shipped")
    source = log(
        spark,
        envelope("c", after=a1),
        envelope("c", after=b1),
        envelope("u", a1, a2),
        envelope("u", b1, b2),
        envelope("d", before=a2),
    )
    found = changes(decode(source))
    assert found.count() == 7
    assert rows(current_state(found), "order_id", "status") == [(1202, "shipped")]


def test_latest_ignores_arrival_order(spark):
    shuffled = HISTORY[::-1]
    assert rows(current_state(images(spark, *shuffled)), "order_id", "event_id") == [(1, 2)]


def test_time_travel(spark):
    df = images(spark, *HISTORY).withColumn("commit", F.col("offset"))
    assert rows(current_state_as_of(df, "commit", 2), "order_id", "event_id") == [(1, 2), (2, 3)]
    assert rows(current_state_as_of(df, "commit", 0), "order_id", "event_id") == [(1, 1)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), parts=st.integers(1, 6))
def test_any_order_copies_and_partitioning_give_the_same_state(spark, seed, parts):
    rng = random.Random(seed)
    mixed = HISTORY + rng.choices(HISTORY, k=3)
    rng.shuffle(mixed)
    state = current_state(images(spark, *mixed).repartition(parts))
    assert rows(state, *ORDER_COLUMNS) == [tuple(B)]
    expected = multiset_digest(orders(spark, B), text_row()).first()
    assert multiset_digest(state, text_row()).first() == expected


def test_hot_key_keeps_one_row_per_task(spark):
    """A third of all images on one key: the rank filter runs before the shuffle too."""
    many = spark.range(9000).select(
        F.lit("t").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("id").alias("offset"),
        F.lit(0).alias("image_seq"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("order_id"),
    )
    latest = latest_per_key(many)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert latest.where("order_id = 7").collect()[0].offset == 8997


def test_row_diff_directions_and_copies(spark):
    left, right = orders(spark, A, C), orders(spark, A, A, B)
    assert rows(diff.row_diff(left, right), "order_id", "event_id", "side") == [
        (1, 2, "unexpected_in_actual"),
        (2, 3, "missing_from_actual"),
    ]
    assert rows(diff.row_diff_all(left, right), "event_id", "side", "copies") == [
        (1, "unexpected_in_actual", 1),
        (2, "unexpected_in_actual", 1),
        (3, "missing_from_actual", 1),
    ]


def test_row_diff_by_key(spark):
    left = orders(spark, order(1), order(2), order(3), order(5), order(5))
    right = orders(spark, order(1), order(2, status="paid", amount=5), order(4), order(5))
    got = rows(diff.row_diff_by_key(left, right, "order_id", ORDER_COLUMNS[1:]))
    assert got == [
        (2, "changed", "status,amount_cents"),
        (3, "missing", None),
        (4, "unexpected", None),
        (5, "duplicate_key", None),
    ]


def test_reconcile(spark):
    row = diff.reconcile(orders(spark, A, C), orders(spark, C, A), ORDER_COLUMNS).first()
    assert (row.diff_count, row.expected_rows, row.actual_rows) == (0, 2, 2)
    assert row.expected_digest == row.actual_digest
    doubled = diff.reconcile(orders(spark, A), orders(spark, A, A), ORDER_COLUMNS).first()
    assert doubled.diff_count == 0 and doubled.expected_digest != doubled.actual_digest


def test_ordered_digest_depends_on_content_only(spark):
    a = ordered_digest(orders(spark, A, C), "order_id", text_row()).first().digest
    b = ordered_digest(orders(spark, C, A).repartition(5), "order_id", text_row()).first().digest
    c = ordered_digest(orders(spark, C, B), "order_id", text_row()).first().digest
    assert a == b != c


def test_rebuild_and_timestamp_coverage(spark):
    values = [envelope("c", after=order(1)), envelope("c", after=order(2)), envelope("u", order(1), order(1, 5))]
    source = log(spark, *values)
    full = rebuild(source)
    assert rows(full, "order_id", "event_id") == [(1, 5), (2, 2)]
    assert rows(rebuild_from_timestamp(source, 1002), "order_id", "event_id") == [(1, 5)]
    gaps = timestamp_coverage(full, changes(decode(source)), 1002)
    assert rows(gaps) == [(2,)]


def test_unrepairable_letters_are_marked(spark):
    from tidemark.operators.decode import dead_letters

    letters = dead_letters(decode(log(spark, "junk", json_repair())))
    assert rows(open_dead_letters(letters), "original_offset", "repairable") == [(0, False), (1, True)]


def json_repair():
    import json

    from helpers import wire

    return json.dumps(
        {"repair_format": "intended-order-v1", "intended_after": wire(order(1)), "intended_operation": "c"}
    )


def test_percentile_bounds(spark):
    from tidemark.functions.ranks import percentile_nearest_rank

    with pytest.raises(ValueError, match="between 0 and 100"):
        percentile_nearest_rank(spark.range(1), [], "id", {"p": 101})
