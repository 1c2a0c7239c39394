"""Rules over run records."""

from __future__ import annotations

import copy
import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import fixtures
from tidemark.sources.ledger_rules import RULES, Rule, validate_by_rules


def broken(spark, documents, rules, kind="k"):
    rows = [(str(i), kind, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    found = validate_by_rules(spark.createDataFrame(rows, "name string, kind string, document string"), rules)
    return sorted((int(r.name), r.rule) for r in found.collect())


def test_predicates(spark):
    rules = [
        Rule("k", "zero", "a.b", "equals", 0),
        Rule("k", "true", "flags.*", "equals", True),
        Rule("k", "some", "list[*].n", "over", 1, least=2),
        Rule("k", "same", "x", "same_as", "y"),
        Rule("k", "order", "x", "not_below", "z"),
        Rule("k", "names", "list[*].name", "each_once", "p,q"),
        Rule("k", "text", "t", "text"),
    ]
    good = {"a": {"b": 0}, "flags": {"f": True}, "list": [{"n": 2, "name": "q"}, {"n": 3.5, "name": "p"}], "x": 4, "y": 4.0, "z": 1, "t": ""}

    def changed(**fields):
        return copy.deepcopy(good) | fields

    documents = [
        good,
        changed(a={"b": "0"}),
        changed(a={"b": None}, flags={}),
        changed(flags={"f": True, "g": "true"}),
        changed(list=[{"n": 2, "name": "p"}]),
        changed(list=[{"n": 2, "name": "p"}, {"n": 1, "name": "p"}]),
        changed(x=0),
        changed(t=7, y=None),
        "not json",
        "[1]",
        None,
        {},
    ]
    everything = sorted((11, r.name) for r in rules)
    assert broken(spark, documents, rules) == [
        (1, "zero"), (2, "true"), (2, "zero"), (3, "true"), (4, "names"), (4, "some"), (5, "names"), (5, "some"),
        (6, "order"), (6, "same"), (7, "same"), (7, "text"), (8, "document"), (9, "document"), (10, "document"), *everything,
    ]
    assert broken(spark, [good], rules, kind="other") == [(0, "kind")]
    with pytest.raises(ValueError, match="unknown predicate"):
        broken(spark, [good], [Rule("k", "r", "a", "near")])


def test_a_right_record_of_each_kind_and_one_without_each_field(spark, sf_dir):
    records = fixtures.kind_records(spark, sf_dir)
    good = records.join(validate_by_rules(records, RULES), "name", "left_anti")
    assert {r.kind for r in good.select("kind").distinct().collect()} == set(fixtures.RECORD_KINDS)
    for kind in fixtures.RECORD_KINDS:
        document = json.loads(good.where(F.col("kind") == kind).first().document)
        paths = sorted({r.path.split("[")[0].split(".*")[0] for r in RULES if r.kind == kind and r.least})
        without = []
        for path in paths:
            copied = copy.deepcopy(document)
            inner, *rest = [copied], *path.split(".")
            for name in rest[:-1]:
                inner = [x[name] for x in inner]
            for x in inner:
                del x[rest[-1]]
            without.append(copied)
        named = {i for i, _ in broken(spark, without, RULES, kind)}
        assert named == set(range(len(paths)))
