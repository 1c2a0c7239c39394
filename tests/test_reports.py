"""Metric text of the exposition format."""

from __future__ import annotations

import json
import math

import pytest

from tidemark.sources.reports import flatten_numeric_paths, parse_end_offsets, parse_metrics


def test_quoted_labels_escapes_and_special_values(spark):
    lines = [
        'm{a="x,y",b="{}",a2="q\\"uo\\\\te\\n"} 1.5',
        'm{a="1",a="2"} NaN 1700000000000',
        "m +Inf",
        "m{} -2e3",
        "# HELP m nothing",
        "m x",
        "m",
        'm{a="open} 1',
    ]
    got = parse_metrics(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.labels for r in got] == [{"a": "x,y", "b": "{}", "a2": 'q"uo\\te\n'}, {"a": "2"}, {}, {}]
    values = [r.metric_value for r in got]
    assert values[0] == 1.5 and math.isnan(values[1]) and values[2:] == [math.inf, -2000.0]


def test_documents_of_any_depth(spark):
    deep = "{" + "".join(f'"k{i}":{{' for i in range(12)) + '"n":7' + "}" * 13
    rows = [(1, deep), (2, '{"a":"}}{{[","b":[1,{"c":"2"}]}'), (3, "not json"), (4, None)]
    got = flatten_numeric_paths(spark.createDataFrame(rows, "id int, doc string"), "doc").collect()
    assert sorted((r.id, r.path, r.number) for r in got) == [
        (1, ".".join([*(f"k{i}" for i in range(12)), "n"]), 7.0),
        (2, "b.0", 1.0),
        (2, "b.1.c", 2.0),
    ]


def test_long_offset_lines_are_read_whole(spark):
    line = "t:" + "0" * (1 << 21) + "7:12"
    row = parse_end_offsets(spark.createDataFrame([(line,)], "value string"), "t").first()
    assert row.log_end_offset == 12 and row.partition == 7


def test_long_labels_and_texts_are_scanned_once(spark):
    long = "x" * (1 << 20)
    lines = [
        f'm{{a="{long}",b="1"}} 7',
        'm{a="' + '\\"' * (1 << 19) + '"} 8',
        "m{" + ",".join(f'l{i % 1000}="{i}"' for i in range(60_000)) + "} 9",
        'm{a="' + long + "} 10",  # an open quote
        "\x01m 11",
        "m 12\x01",
        'm {a="\x01"} 13',
        'm{a="no space"}14',
        "m{a=\"{[\"} 14 x",
        "m" + " " * (1 << 20),
    ]
    got = parse_metrics(spark.createDataFrame([(x, "n") for x in lines], "value string, name string")).collect()
    assert [r.metric_value for r in got] == [7.0, 8.0, 9.0, 13.0] and {r.name for r in got} == {"m"}
    assert got[0].labels == {"a": long, "b": "1"} and got[1].labels == {"a": '"' * (1 << 19)}
    assert got[2].labels == {f"l{i}": str(59_000 + i) for i in range(1000)} and got[3].labels == {"a": "\x01"}


def test_long_json_texts_have_all_their_leaves(spark):
    long = json.dumps({"text": '}{"' * (1 << 19), "n": 1, "list": list(range(50_000))})
    deep = '{"a":' * 60 + "5" + "}" * 60
    docs = spark.createDataFrame([(1, long), (2, deep), (3, "[]"), (4, "7")], "id int, doc string")
    got = {(r.id, r.path): r.number for r in flatten_numeric_paths(docs, "doc").collect()}
    assert len(got) == 50_003 and got[1, "n"] == 1.0 and got[1, "list.49999"] == 49_999.0
    assert got[2, ".".join("a" * 60)] == 5.0 and got[4, ""] == 7.0
    with pytest.raises(Exception, match="deeper than 3"):
        flatten_numeric_paths(docs, "doc", depth=3).collect()
