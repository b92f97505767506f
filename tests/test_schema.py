"""Compiled schemas against a plain validator, and what is refused."""

import json
import random

import pytest
from pyspark.sql import functions as F

from curata.operators import schema as S


def plain(schema, node, x, path=()):
    """(path, keyword) pairs by the rules as they are told."""
    at = lambda *more: ".".join(map(str, (*path, *more))) or "<root>"
    if isinstance(node, bool):
        return [] if node else [(at(), "false")]
    out = plain(schema, schema["$defs"][node["$ref"].rsplit("/", 1)[1]], x, path) if "$ref" in node else []
    is_number = isinstance(x, int | float) and not isinstance(x, bool)
    kinds = {"string": isinstance(x, str), "integer": is_number and x == int(x), "number": is_number, "boolean": isinstance(x, bool), "array": isinstance(x, list), "object": isinstance(x, dict), "null": x is None}
    same = lambda a, b: type(a) is type(b) and a == b or isinstance(a, int | float) and isinstance(b, int | float) and bool not in (type(a), type(b)) and a == b
    broken = {
        "type": lambda w: not any(kinds[k] for k in ([w] if isinstance(w, str) else w)), "enum": lambda w: not any(same(x, y) for y in w), "const": lambda w: not same(x, w),
        "minLength": lambda w: isinstance(x, str) and len(x) < w, "minimum": lambda w: is_number and x < w, "exclusiveMaximum": lambda w: is_number and x >= w, "maxItems": lambda w: isinstance(x, list) and len(x) > w,
        "uniqueItems": lambda w: isinstance(x, list) and len({json.dumps(i) for i in x}) < len(x), "not": lambda w: not plain(schema, w, x), "anyOf": lambda w: all(plain(schema, s, x) for s in w),
        "oneOf": lambda w: sum(not plain(schema, s, x) for s in w) != 1,
    }
    out += [(at(), k) for k in node if k in broken and broken[k](node[k])]
    if isinstance(x, dict):
        out += [(at(k), "required") for k in node.get("required", ()) if k not in x]
        for k, v in x.items():
            if k in node.get("properties", {}):
                out += plain(schema, node["properties"][k], v, (*path, k))
            elif node.get("additionalProperties", True) is False:
                out.append((at(k), "additionalProperties"))
            elif node.get("additionalProperties", True) is not True:
                out += plain(schema, node["additionalProperties"], v, (*path, k))
    if isinstance(x, list) and "items" in node:
        out += [f for i, v in enumerate(x) for f in plain(schema, node["items"], v, (*path, i))]
    return out + [f for s in node.get("allOf", ()) for f in plain(schema, s, x, path)]


SCHEMA = {
    "$defs": {"name": {"type": "string", "minLength": 2}, "pair": {"type": "array", "maxItems": 2, "items": {"type": ["number", "null"], "minimum": 0}}},
    "type": "object", "required": ["a", "b"], "additionalProperties": {"$ref": "#/$defs/pair", "uniqueItems": True},
    "properties": {
        "a": {"allOf": [{"$ref": "#/$defs/name"}, {"not": {"const": "no"}}]}, "b": {"oneOf": [{"type": "integer"}, {"type": "number", "exclusiveMaximum": 5}]}, "it's": {"enum": ["x", 1, None, True, [1, 2]]},
        "deep": {"type": "array", "items": {"type": "object", "required": ["p"], "additionalProperties": False, "properties": {"p": {"anyOf": [{"$ref": "#/$defs/pair"}, {"type": "boolean"}]}, "q": {"$ref": "#/$defs/name"}}}}, "gone": False,
    },
}


def value(r, depth=3):
    kind = r.choice("snbazo" if depth else "snbz")
    return {
        "s": lambda: r.choice(["", "no", "yes", "x", "é"]), "n": lambda: r.choice([0, 1, -1, 2.5, 7, 5.0, 1e3]), "b": lambda: r.random() < 0.5, "z": lambda: None,
        "a": lambda: [value(r, depth - 1) for _ in range(r.randint(0, 3))], "o": lambda: {k: value(r, depth - 1) for k in r.sample(["p", "q", "z", "a"], r.randint(0, 3))},
    }[kind]()


def test_compiled_findings_are_those_of_a_plain_walk(spark):
    r = random.Random(2)
    rows = [value(r) if i % 10 == 0 else {k: value(r) for k in r.sample(["a", "b", "it's", "deep", "gone", "other", "more"], r.randint(0, 6))} for i in range(400)]
    rows += [{"a": "yes", "b": 7, "deep": [{"p": [1, None]}, {"p": True, "q": "xx"}], "it's": [1, 2]}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(rows)] + [(-1, "{"), (-2, None), (-3, "")], "i int, raw string")
    got = sorted((x.record_index, x.path, x.keyword) for x in S.schema_findings(df, "i", "raw", SCHEMA).collect())
    want = [(i, *f) for i, x in enumerate(rows) for f in plain(SCHEMA, SCHEMA, x)] + [(-k, "<root>", "json") for k in (1, 2, 3)]
    assert got == sorted(want) and len(got) > 500 and not plain(SCHEMA, SCHEMA, rows[-1])
    assert S.schema_findings(df.limit(0), "i", "raw", SCHEMA).count() == 0


@pytest.mark.parametrize("schema", [{"patternProperties": {}}, {"$ref": "other.json"}, {"$ref": "#/$defs/none", "$defs": {}}, {"properties": {"a": {"if": True}}}, {"$defs": {"n": {"items": {"$ref": "#/$defs/n"}}}, "$ref": "#/$defs/n"}])
def test_what_would_be_lost_is_refused(spark, schema):
    with pytest.raises(ValueError):
        S.findings(F.lit("{}"), schema)


def test_schema_file_and_its_fields(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(SCHEMA))
    assert S.read_schema(spark, f"file://{tmp_path}/s.json") == SCHEMA
    fields = S.fields_of({"required": ["t"], "$defs": {"y": {"type": ["integer", "null"], "minimum": 1, "not": {"const": 0}}, "o": {"type": "object"}}, "properties": {"t": {"type": "string"}, "y": {"$ref": "#/$defs/y"}, "l": {"type": "array", "minItems": 1, "items": {"type": "string"}}, "o": {"type": "array", "items": {"$ref": "#/$defs/o"}}, "e": {"enum": ["a"]}}})
    assert [(f.name, f.kind, f.required, f.nullable) for f in fields] == [("t", "string", True, False), ("y", "int", False, True), ("l", "array_str", False, False), ("o", "array_obj", False, False), ("e", "string", False, False)]
    assert fields[1].low == 1 and fields[1].not_zero and fields[2].min_items == 1 and fields[4].enum == ("a",)
