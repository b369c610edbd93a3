"""JSON Schema keywords one by one, values written by hand."""

import json

import pytest

from loomstone.operators import schema as S

#: schema, values that fit, values that do not with their violations
KEYWORDS = [
    ({"type": "string"}, ["x", ""], [(1, "$ type"), (None, "$ type"), ([], "$ type")]),
    ({"type": ["string", "null"]}, ["x", None], [(1, "$ type")]),
    ({"type": "integer"}, [1, -3, 2.0], [(1.5, "$ type"), ("1", "$ type"), (True, "$ type")]),
    ({"type": "number"}, [1, 1.5], [("1", "$ type"), (False, "$ type")]),
    ({"type": "boolean"}, [True], [(0, "$ type")]),
    ({"type": "object"}, [{}, {"a": 1}], [([], "$ type")]),
    ({"enum": ["a", 1, None, {"b": [1], "a": 2}]}, ["a", 1, None, {"a": 2, "b": [1]}], [("b", "$ enum"), (2, "$ enum")]),
    ({"const": "k"}, ["k"], [("l", "$ const")]),
    ({"minimum": 1, "maximum": 3}, [1, 3, "0"], [(0, "$ minimum"), (3.1, "$ maximum")]),
    ({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, [2, None], [(1, "$ exclusiveMinimum"), (3, "$ exclusiveMaximum")]),
    ({"multipleOf": 0.5}, [1, 1.5], [(1.2, "$ multipleOf")]),
    ({"minLength": 2, "maxLength": 3}, ["ab", "äöü", 7], [("a", "$ minLength"), ("abcd", "$ maxLength")]),
    ({"pattern": "^[a-z]+$"}, ["ab", 1], [("A", "$ pattern"), ("a b", "$ pattern")]),
    ({"required": ["a", "b"]}, [{"a": None, "b": 1}, "x"], [({"a": 1}, "$.b required"), ({}, "$.a required|$.b required")]),
    ({"properties": {"a": {"type": "string"}, "o'k": {"minimum": 1}}}, [{}, {"a": "x"}, {"c": 1}], [({"a": 1}, "$.a type"), ({"a": None, "o'k": 0}, "$.a type|$.o'k minimum")]),
    ({"properties": {"a": {}}, "additionalProperties": False}, [{"a": 1}, {}], [({"b": 1, "a": 1}, "$.b additionalProperties")]),
    ({"properties": {"a": {}}, "additionalProperties": {"type": "string"}}, [{"a": 1, "b": "x"}], [({"b": 1}, "$.b type")]),
    ({"items": {"type": "string"}}, [[], ["x"], "no list"], [([1, "x", None], "$[0] type|$[2] type")]),
    ({"items": {"items": {"minimum": 1}}}, [[[1], []]], [([[1], [2, 0]], "$[1][1] minimum")]),
    ({"minItems": 1, "maxItems": 2}, [[1], 5], [([], "$ minItems"), ([1, 2, 3], "$ maxItems")]),
    ({"uniqueItems": True}, [[1, 2, "1"]], [([1, 2, 1], "$ uniqueItems"), ([{"a": 1, "b": 2}, {"b": 2, "a": 1}], "$ uniqueItems")]),
    ({"minProperties": 1, "maxProperties": 2}, [{"a": 1}], [({}, "$ minProperties"), ({"a": 1, "b": 1, "c": 1}, "$ maxProperties")]),
    ({"allOf": [{"type": "string"}, {"minLength": 2}]}, ["ab"], [("a", "$ minLength"), (1, "$ type")]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["a", 6], [(1, "$ anyOf")]),
    ({"oneOf": [{"minimum": 1}, {"maximum": 3}]}, [0, 4], [(2, "$ oneOf")]),
    ({"not": {"type": "null"}}, [1], [(None, "$ not")]),
    ({"definitions": {"t": {"type": "object", "properties": {"next": {"$ref": "#/definitions/t"}, "n": {"type": "integer"}}}}, "$ref": "#/definitions/t"}, [{"n": 1, "next": {"n": 2}}], [({"next": {"next": {"n": "x"}}}, "$.next.next.n type")]),
    ({"properties": {"a": False, "b": True}}, [{"b": 1}], [({"a": 1}, "$.a false")]),
]


@pytest.mark.parametrize("case", KEYWORDS, ids=lambda c: "+".join(c[0]))
def test_keyword(spark, case):
    schema, good, bad = case
    rows = [(f"good {i}", json.dumps(v)) for i, v in enumerate(good)] + [(f"bad {i}", json.dumps(v)) for i, (v, _) in enumerate(bad)]
    got = {}
    for r in S.violations(spark.createDataFrame(rows, "k string, v string"), "k", "v", schema).collect():
        got.setdefault(r["k"], []).append(f"{r['path']} {r['keyword']}")
    assert {k: sorted(v) for k, v in got.items()} == {f"bad {i}": sorted(want.split("|")) for i, (_, want) in enumerate(bad)}


def test_cases(spark):
    fine = {
        "case_id": "a_1", "metadata": {"domain": "legal", "relation_type": "scope", "complexity_level": 2, "source_status": "real", "license": "x"}, "representations": {"raw": "r", "annotated": "a", "compiled": "c"}, "query": "q",
        "gold_answer": {"full": "f", "minimal": "m", "required_relations": ["scope"]}, "local_probes": [{"fragment_id": "1", "probe": "p", "expected_answer": "e"}] * 2, "failure_examples": {"refusal": ["no"]}, "controls": {"parametric_contamination_risk": "low"},
    }
    broken = json.loads(json.dumps(fine))
    broken["case_id"] = "A 1"
    broken["metadata"] |= {"domain": "none", "complexity_level": 4}
    del broken["representations"]["raw"], broken["query"]
    broken["local_probes"] = [{"fragment_id": 1, "probe": "p"}]
    broken["failure_examples"]["refusal"] = ["a", 2]
    broken["controls"]["position_variants_supported"] = "yes"
    df = spark.createDataFrame([("fine", json.dumps(fine)), ("broken", json.dumps(broken)), ("text", "{"), ("null", None), ("list", "[]")], "k string, v string")
    got = {}
    for r in S.violations(df, "k", "v", S.CASE_SCHEMA).collect():
        got.setdefault(r["k"], set()).add((r["path"], r["keyword"]))
    assert set(got) == {"broken", "text", "null", "list"} and got["text"] == got["null"] == {("$", "json")} and got["list"] == {("$", "type")}
    assert got["broken"] == {
        ("$.case_id", "pattern"), ("$.metadata.domain", "enum"), ("$.metadata.complexity_level", "maximum"), ("$.representations.raw", "required"), ("$.query", "required"), ("$.local_probes", "minItems"),
        ("$.local_probes[0].fragment_id", "type"), ("$.local_probes[0].expected_answer", "required"), ("$.failure_examples.refusal[1]", "type"), ("$.controls.position_variants_supported", "type"),
    }
