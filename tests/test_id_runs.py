"""Id sets as runs against plain sets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import id_runs
from tidemark.operators import audits


@pytest.mark.parametrize("block", [4, 65_536])
def test_runs_compare_like_sets(spark, monkeypatch, block):
    monkeypatch.setattr(id_runs, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(3):
        ids = [rng.randint(-30, 60) for _ in range(rng.randint(0, 60))]
        given = [(a, a + rng.randint(-2, 12)) for a in (rng.randint(-40, 60) for _ in range(rng.randint(0, 6)))]
        wanted = {i for a, b in given for i in range(a, b + 1)}
        frame = spark.createDataFrame([(i,) for i in [*ids, None, *ids[:3]]], "id long")
        runs = id_runs.cut_runs(spark.createDataFrame(given, "first long, last long"))
        row = id_runs.compare_runs(id_runs.runs_of(frame, "id"), runs).first()
        have = set(ids)
        assert tuple(row) == (len(have), len(wanted), len(have & wanted), len(wanted - have), len(have - wanted))
        kept = [r.id for r in id_runs.within_runs(frame, "id", runs).collect()]
        assert sorted(kept) == sorted(i for i in [*ids, *ids[:3]] if i in wanted)


def test_expected_ids_name_the_set_that_is_wrong(spark):
    ids = spark.range(1, 101).withColumnRenamed("id", "event_id")
    runs = spark.createDataFrame([(1, 50), (51, 100)], "first long, last long")
    n = spark.createDataFrame([(100,)], "n long")
    right = audits.expected_event_ids(ids, ids, ids, runs, runs, n).first()
    assert right.consistent and right.current_ids == 100
    for broken, field in (
        ((ids, ids.where("event_id <> 40"), ids), "current_sets_match"),
        ((ids, ids, ids.union(spark.range(500, 501).toDF("event_id"))), "changelog_set_match"),
        ((ids, ids, ids.union(ids.limit(1))), "changelog_count_match"),
    ):
        row = audits.expected_event_ids(*broken, runs, runs, n).first()
        assert not row[field] and not row.consistent
    empty = audits.expected_event_ids(*[ids.where(F.lit(False))] * 3, runs, runs, n).first()
    assert empty.source_missing == 100 and not empty.consistent
