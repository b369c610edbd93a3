"""BM12: JSON values checked against a JSON Schema that is compiled to one built-in expression.

compile() turns a schema into an expression over a VARIANT that gives the violations of a value as an array of (path, keyword):
each keyword is a test, a list's items are a transform, references are put in where they stand. So a row is checked where it
lies, in the JVM, with no shuffle and no library, and all its violations are found and not only the first.

Keywords: type, enum, const, required, properties, additionalProperties (false or a schema), minimum, maximum, exclusiveMinimum,
exclusiveMaximum, multipleOf, minLength, maxLength, pattern, items, minItems, maxItems, uniqueItems, minProperties, maxProperties, allOf, anyOf,
oneOf, not, and $ref within the schema. A keyword says nothing on values of another type, as the standard has it.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions.dialect import SPARK as D

NONE = "cast(array() AS array<struct<path: string, keyword: string>>)"
#: How deep references may stand in one another: a schema that refers to itself is checked to this depth.
DEEPEST = 8
_names = itertools.count()


def _path(key: str) -> str:
    """A member's variant path."""
    return D.lit("$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']") if "'" not in key and '"' not in key else D.lit('$["' + key + '"]')


def _hit(test: str, path: str, keyword: str) -> str:
    return f"CASE WHEN {test} THEN array(named_struct('path', {path}, 'keyword', '{keyword}')) ELSE {NONE} END"


def _let(value: str, body) -> str:
    """body over a name for value, which is worked out once."""
    v = f"v{next(_names)}"
    return f"transform(array({value}), {v} -> {body(v)})[0]"


def _kind(v: str) -> str:
    """object, array, string, number, boolean or null."""
    k = f"regexp_extract(schema_of_variant({v}), '^[A-Z]+', 0)"
    return f"CASE {k} WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'STRING' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VOID' THEN 'null' ELSE 'number' END"


def _canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def compile(schema, v: str, path: str = "'$'", root=None, depth: int = 0) -> str:
    """An expression for the violations of the variant v: array<struct<path: string, keyword: string>>, never null."""
    root = schema if root is None else root
    if schema is True or schema == {}:
        return NONE
    if schema is False:
        return _hit("true", path, "false")
    if "$ref" in schema:
        if depth >= DEEPEST:
            return NONE
        target = root
        for part in schema["$ref"].lstrip("#").strip("/").split("/") if schema["$ref"].strip("#/") else []:
            target = target[part.replace("~1", "/").replace("~0", "~")]
        return compile(target, v, path, root, depth + 1)
    return _let(_kind(v), lambda kind: f"concat({', '.join(_tests(schema, v, kind, path, root, depth)) or NONE})")


def _tests(schema: dict, v: str, kind: str, path: str, root, depth: int) -> list[str]:
    sub = lambda s, x, p: compile(s, x, p, root, depth)
    is_ = lambda k, test: f"{kind} = '{k}' AND {test}"
    text, number, doc = f"variant_get({v}, '$', 'string')", f"variant_get({v}, '$', 'double')", f"to_json({v})"
    out = []
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fine = [f"({kind} = 'number' AND {number} = floor({number}))" if k == "integer" else f"{kind} = '{k}'" for k in kinds]
        out.append(_hit(f"NOT ({' OR '.join(fine)})", path, "type"))
    if "enum" in schema:
        out.append(_hit(f"{doc} NOT IN ({', '.join(D.lit(_canonical(x)) for x in schema['enum'])})", path, "enum"))
    if "const" in schema:
        out.append(_hit(f"{doc} <> {D.lit(_canonical(schema['const']))}", path, "const"))
    for k, sign in (("minimum", "<"), ("maximum", ">"), ("exclusiveMinimum", "<="), ("exclusiveMaximum", ">=")):
        if k in schema:
            out.append(_hit(is_("number", f"{number} {sign} {float(schema[k])!r}D"), path, k))
    if "multipleOf" in schema:
        out.append(_hit(is_("number", f"{number} / {float(schema['multipleOf'])!r}D <> floor({number} / {float(schema['multipleOf'])!r}D)"), path, "multipleOf"))
    for k, sign in (("minLength", "<"), ("maxLength", ">")):
        if k in schema:
            out.append(_hit(is_("string", f"length({text}) {sign} {int(schema[k])}"), path, k))
    if "pattern" in schema:
        out.append(_hit(is_("string", f"NOT {text} RLIKE {D.lit(schema['pattern'])}"), path, "pattern"))
    items = f"CASE WHEN {kind} = 'array' THEN cast({v} AS array<variant>) ELSE array() END"
    for k, sign in (("minItems", "<"), ("maxItems", ">")):
        if k in schema:
            out.append(_hit(is_("array", f"size({items}) {sign} {int(schema[k])}"), path, k))
    if schema.get("uniqueItems"):
        out.append(_hit(is_("array", f"size(array_distinct(transform({items}, u -> to_json(u)))) < size({items})"), path, "uniqueItems"))
    if "items" in schema:
        x, i = f"v{next(_names)}", f"v{next(_names)}"
        out.append(f"flatten(transform({items}, ({x}, {i}) -> {sub(schema['items'], x, f"concat({path}, '[', {i}, ']')")}))")
    keys = f"CASE WHEN {kind} = 'object' THEN json_object_keys({doc}) ELSE array() END"
    for k, sign in (("minProperties", "<"), ("maxProperties", ">")):
        if k in schema:
            out.append(_hit(is_("object", f"size({keys}) {sign} {int(schema[k])}"), path, k))
    if schema.get("required"):
        out.append(f"CASE WHEN {kind} = 'object' THEN transform(array_except({D.words(schema['required'])}, {keys}), r -> named_struct('path', concat({path}, '.', r), 'keyword', 'required')) ELSE {NONE} END")
    known = schema.get("properties", {})
    for k, s in known.items():
        member = _let(f"CASE WHEN {kind} = 'object' THEN variant_get({v}, {_path(k)}, 'variant') END", lambda x, s=s, k=k: f"CASE WHEN {x} IS NULL THEN {NONE} ELSE {sub(s, x, f'concat({path}, {D.lit("." + k)})')} END")
        out.append(member)
    if schema.get("additionalProperties", True) is not True:
        more = f"filter({keys}, k -> NOT array_contains({D.words(list(known)) if known else D.empty()}, k))"
        if schema["additionalProperties"] is False:
            out.append(f"transform({more}, k -> named_struct('path', concat({path}, '.', k), 'keyword', 'additionalProperties'))")
        else:
            x, k = f"v{next(_names)}", f"v{next(_names)}"
            whole = f"CASE WHEN {kind} = 'object' THEN cast({v} AS map<string, variant>) END"
            out.append(f"flatten(transform({more}, {k} -> {_let(f'element_at({whole}, {k})', lambda x: sub(schema['additionalProperties'], x, f"concat({path}, '.', {k})"))}))")
    for s in schema.get("allOf", []):
        out.append(sub(s, v, path))
    fits = lambda s: f"CASE WHEN size({sub(s, v, path)}) = 0 THEN 1 ELSE 0 END"
    if "anyOf" in schema:
        out.append(_hit(f"{' + '.join(map(fits, schema['anyOf']))} = 0", path, "anyOf"))
    if "oneOf" in schema:
        out.append(_hit(f"{' + '.join(map(fits, schema['oneOf']))} <> 1", path, "oneOf"))
    if "not" in schema:
        out.append(_hit(f"{fits(schema['not'])} = 1", path, "not"))
    return out


def violations(df: DataFrame, key: str, value: str, schema: dict) -> DataFrame:
    """(key, path, keyword): a row for each violation of the JSON text in `value`; what is no JSON violates `json`."""
    rows = df.select(F.col(key), F.expr(f"try_parse_json({value})").alias("lm_v"))
    found = rows.select(key, F.expr(f"CASE WHEN lm_v IS NULL THEN array(named_struct('path', '$', 'keyword', 'json')) ELSE {compile(schema, 'lm_v')} END").alias("lm_f"))
    # Outer, and rows without a violation left out afterwards: an inner explode has the planner put a filter below, where every mention of a
    # value parses it again. A violation is never null.
    return found.select(key, F.explode_outer("lm_f").alias("lm_x")).where("lm_x IS NOT NULL").select(key, "lm_x.path", "lm_x.keyword")


def _texts(*names: str) -> dict:
    return {n: {"type": "string"} for n in names}


_LIST = {"type": "array", "items": {"type": "string"}}
#: ---- fixed values: what a case must be ----
CASE_SCHEMA = {
    "type": "object",
    "required": ["case_id", "metadata", "representations", "query", "gold_answer", "local_probes", "failure_examples", "controls"],
    "properties": {
        "case_id": {"type": "string", "pattern": "^[a-z0-9_]+$"},
        "metadata": {
            "type": "object", "required": ["domain", "relation_type", "complexity_level", "source_status", "license"],
            "properties": {
                "domain": {"type": "string", "enum": ["corporate_policy", "regulatory", "clinical", "education", "technical_ops", "eligibility", "legal"]},
                "relation_type": {"type": "string", "enum": ["exception", "override", "scope", "precondition", "sequence", "contraindication", "temporal_dependency", "exception_of_exception"]},
                "complexity_level": {"type": "integer", "minimum": 1, "maximum": 3},
                "source_status": {"type": "string", "enum": ["synthetic", "real", "adapted"]},
                **_texts("license", "notes"),
            },
        },
        "representations": {"type": "object", "required": ["raw", "annotated", "compiled"], "properties": _texts("raw", "annotated", "compiled")},
        "query": {"type": "string"},
        "gold_answer": {"type": "object", "required": ["full", "minimal", "required_relations"], "properties": {**_texts("full", "minimal"), "required_relations": _LIST}},
        "local_probes": {"type": "array", "minItems": 2, "items": {"type": "object", "required": ["fragment_id", "probe", "expected_answer"], "properties": _texts("fragment_id", "probe", "expected_answer")}},
        "failure_examples": {"type": "object", "properties": {"composition_hallucination": _LIST, "wrong_escalation": _LIST, "refusal": _LIST, **_texts("retrieval_failure_note")}},
        "controls": {
            "type": "object",
            "properties": {"necessary_fragments": _LIST, **_texts("negative_control_query", "negative_control_gold"), "position_variants_supported": {"type": "boolean"}, "parametric_contamination_risk": {"type": "string", "enum": ["low", "medium", "high"]}},
        },
        "provenance": {"type": "object", "properties": _texts("source_status_detail", "source_title", "source_organization", "source_url", "source_accessed", "adaptation_method", "professional_guidance_warning")},
    },
}
#: ---- end of fixed values ----
