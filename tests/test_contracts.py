"""Schema rules: unions, broken candidates, several candidates, strict checks of the ledger."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contracts, schema_tree


def _schema(**types):
    fields = [{"name": n, "type": t, **({"default": None} if isinstance(t, list) else {})} for n, t in types.items()]
    return json.dumps({"type": "record", "name": "R", "fields": fields})


def _evolution(spark, old, new):
    registry = spark.createDataFrame([("s", 1, old), ("s", 2, new)], "subject string, version int, schema_json string")
    return contracts.evaluate_evolution(contracts.registry_fields(registry), 1, 2).first()


def test_unions_follow_resolution(spark):
    def compatible(old, new):
        return _evolution(spark, _schema(a=old), _schema(a=new)).backward_compatible

    assert compatible("string", ["null", "string"]) and compatible("int", ["null", "long"])
    assert compatible(["null", "string"], ["string", "null"]) and compatible(["int"], "long")
    assert not compatible(["null", "string"], "string") and not compatible("string", ["null", "int"])


def test_broken_candidates_are_not_compatible(spark):
    for new in ("{not json", json.dumps({"type": "record", "fields": []}), json.dumps({"type": "enum"})):
        row = _evolution(spark, _schema(a="int"), new)
        assert not row.backward_compatible and not row.passed


def test_each_candidate_gets_its_own_version(spark):
    registry = spark.createDataFrame([("s", 3, _schema(a="int"))], "subject string, version int, schema_json string")
    rows = [("s", _schema(a="int", b=["null", "string"])), ("s", _schema(a="long")), ("s", _schema(a="string")), ("n", _schema(x="int")), ("m", "{")]
    candidates = spark.createDataFrame([*rows, rows[0]], "subject string, schema_json string")
    got = contracts.admit_versions(registry, candidates).collect()
    assert sorted((r.subject, r.version) for r in got) == [("n", 1), ("s", 3), ("s", 4), ("s", 5)]
    assert _schema(a="string") not in {r.schema_json for r in got}


def test_only_a_boolean_true_passes_a_ledger_check(spark):
    from tidemark.sources.runs import validate_ledger

    documents = [
        (str(i), json.dumps({"failure_class": "mis-keying", "checks": {"c": value}, "summary": {"passed": True}}))
        for i, value in enumerate([True, None, "true", False, 1])
    ]
    ledger = spark.createDataFrame(documents, "name string, document string")
    broken = {r.name for r in validate_ledger(ledger).where("rule = 'drill.checks'").collect()}
    assert broken == {"1", "2", "3", "4"}


def _nodes(spark, *schemas):
    rows = [("s", i + 1, s if isinstance(s, str) else json.dumps(s)) for i, s in enumerate(schemas)]
    return schema_tree.schema_nodes(spark.createDataFrame(rows, "subject string, version int, schema_json string"))


def _record(name, **types):
    return {"type": "record", "name": name, "fields": [{"name": n, "type": t} for n, t in types.items()]}


def test_nested_types_are_compared_by_name_and_place(spark):
    def verdict(old, new):
        row = schema_tree.evaluate_tree(_nodes(spark, old, new), 1, 2).first()
        return row.backward_compatible, row.removed_fields, row.changed_field_types, row.unreadable

    inner, wider = _record("I", x="int"), _record("I", x="long")
    old = _record("R", a=inner, b="I", c={"type": "map", "values": ["null", "I"]})
    # defined at another place, promoted inside
    assert verdict(old, _record("R", a={"type": wider}, b="I", c={"type": "map", "values": ["I", "null"]})) == (True, "", "I.x", "")
    assert verdict(old, _record("Q", a=inner, b="I", c={"type": "map", "values": "I"})) == (False, "", "c{}", "c{}")
    assert verdict(old, _record("R", a=_record("J", x="int"), b="J", c={"type": "map", "values": ["null", "J"]})) == (False, "", "a,b,c{}", "a,b,c{}")
    assert verdict(old, _record("R", a=_record("I", y="int"), b="I"))[:2] == (False, "I.x,c")
    fixed = {"type": "fixed", "name": "F", "size": 4}
    assert verdict(_record("R", f=fixed), _record("R", f={**fixed, "size": 8})) == (False, "", "f", "F")
    assert verdict(_record("R", f="int"), _record("R", f={"type": "int", "logicalType": "date"})) == (True, "", "f", "")


def test_problems_of_nested_schemas_have_places(spark):
    broken = _record("R", a={"type": "array"}, b={"type": "enum", "name": "E"}, c=_record("I"), d=7, e="Missing", f={"type": "record", "fields": []})
    got = {r.path: r.problem for r in _nodes(spark, broken).where("problem IS NOT NULL").collect()}
    assert got == {
        "a": "array has no items", "b": "enum has no symbols", "c": "record has no fields",
        "d": "type is neither a name nor an object with one", "e": "unknown type Missing", "f": "named type without a name",
    }
    assert {r.problem for r in _nodes(spark, "{", "[]", '{"type":"enum"}').collect()} == {"schema is not JSON", "root is not a record"}


def test_nested_fields_are_mutated_everywhere(spark):
    nodes = _nodes(spark, _record("R", event_id="long", before=["null", _record("V", event_id="long", n="int")]))
    mutated = schema_tree.mutate_nodes(nodes, "event_id", "string")
    assert {r.mutations for r in mutated.collect()} == {2}
    types = {(r.path, r.key) for r in mutated.where("node = 'type'").collect()}
    assert {("event_id", "string"), ("V.event_id", "string"), ("V.n", "int")} <= types and ("event_id", "long") not in types
    both = nodes.unionByName(mutated.drop("mutations").withColumn("version", F.lit(2)))
    row = schema_tree.evaluate_tree(both, 1, 2).first()
    assert row.changed_field_types == "V.event_id,event_id" and not row.backward_compatible
    with pytest.raises(Exception, match="no field named amount"):
        schema_tree.mutate_nodes(nodes, "amount", "string").collect()


def test_mutation_sends_no_schema_counts_to_every_task(spark):
    registry = spark.createDataFrame(
        [("s", 1, _schema(a="int", b="int")), ("s", 2, _schema(a="long")), ("t", 1, _schema(a="int"))],
        "subject string, version int, schema_json string",
    )
    mutated = contracts.mutate_types(contracts.registry_fields(registry), "a", "string")
    assert "Broadcast" not in mutated._jdf.queryExecution().executedPlan().toString()
    found = {(r.subject, r.version, r.field, r.type, r.mutations) for r in mutated.collect()}
    assert found == {("s", 1, "a", "string", 1), ("s", 1, "b", "int", 1), ("s", 2, "a", "string", 1), ("t", 1, "a", "string", 1)}
    with pytest.raises(Exception, match="no field named b"):
        contracts.mutate_types(contracts.registry_fields(registry), "b", "string").collect()
