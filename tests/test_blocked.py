from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import blocked
from tidemark.functions.columns import floor_div
from tidemark.functions.ranks import median_interpolated, percentile_nearest_rank


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = [
        (0 if rng.random() < 0.4 else rng.randint(1, 4), i, rng.choice([None, 1, 2, 3, -4]))
        for i in range(600)
    ]
    return spark.createDataFrame(rows, "k int, pos long, v int").repartition(5).cache()


def test_equals_plain_window(data):
    w = Window.partitionBy("k").orderBy("pos")
    plain = data.select(
        "k",
        "pos",
        F.row_number().over(w).cast("bigint").alias("n"),
        F.sum("v").over(w).alias("s"),
        F.max("v").over(w).alias("m"),
        F.min("v").over(w).alias("l"),
        F.lag("v").over(w).alias("p"),
        F.sum("v").over(Window.partitionBy("k")).alias("t"),
    )
    ours = blocked.running(
        data,
        ["k"],
        ["pos"],
        floor_div(F.col("pos"), 37),
        [
            blocked.Running("n", "count"),
            blocked.Running("s", "sum", "v"),
            blocked.Running("m", "max", "v"),
            blocked.Running("l", "min", "v"),
            blocked.Running("p", "lag", "v"),
            blocked.Running("t", "total", "v"),
        ],
    ).drop("v")
    left = {(r.k, r.pos): tuple(r)[2:] for r in plain.collect()}
    right = {(r.k, r.pos): tuple(r)[2:] for r in ours.collect()}
    assert left == right


@pytest.mark.parametrize("width", [1, 7, 65_536])
def test_ranks_against_brute_force(spark, width):
    rng = random.Random(width)
    values = [(g, rng.randint(-50, 50)) for g in (1, 2) for _ in range(97 * g)] + [(3, 5)]
    df = spark.createDataFrame(values, "g int, v long")
    wanted = {"p0": 0, "p50": 50, "p95": 95, "p100": 100}
    got = {r.g: tuple(r)[1:] for r in percentile_nearest_rank(df, ["g"], "v", wanted, width).collect()}
    medians = {r.g: r.m for r in median_interpolated(df, ["g"], "v", "m", width).collect()}
    for g in (1, 2, 3):
        ordered = sorted(v for k, v in values if k == g)
        n = len(ordered)
        assert got[g] == tuple(ordered[max(1, math.ceil(p * n / 100)) - 1] for p in wanted.values())
        assert medians[g] == (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


def test_join_per_key(spark, data):
    per_key = spark.createDataFrame([(0, "a"), (1, "b")], "k int, name string")
    ours = blocked.join_per_key(data, per_key, ["k"], floor_div(F.col("pos"), 11))
    plain = data.join(per_key, "k")
    assert sorted(map(str, ours.select("k", "pos", "name").collect())) == sorted(
        map(str, plain.select("k", "pos", "name").collect())
    )


def test_literal_table_fails_beyond_its_bound(spark):
    from tidemark.session import literal_table

    df = spark.range(5)
    assert literal_table(df, 5, "id").count() == 5
    with pytest.raises(ValueError, match="more than 4"):
        literal_table(df, 4, "id")


def test_starts_do_not_shuffle_the_log(spark, tmp_path):
    from tidemark.schemas import LOG_RECORD
    from tidemark.sources import cdc_log

    path = str(tmp_path / "log")
    spark.createDataFrame([("t", p, o, o, b"k", b"v") for p in range(3) for o in range(9)], LOG_RECORD).write.parquet(path)
    log = cdc_log.read_log(spark, path)
    kept = cdc_log.from_starts(log, cdc_log.offsets_for_timestamp(log, 5))
    assert kept.count() == 12
    assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
