"""Schema files: a JSON Schema compiled into one expression over VARIANT, whose value is the array of a record's findings with their paths.

Supported: $ref into $defs, type, enum, const, pattern, minLength, maxLength, minimum, maximum, exclusiveMinimum, exclusiveMaximum, properties, required, additionalProperties, items, minItems, maxItems,
uniqueItems, not, allOf, anyOf, oneOf, true and false. Names that say nothing about values are passed over; any other keyword is refused, so that no rule is silently lost.
Everything stays in the JVM: arrays and objects are walked by higher-order functions, to the depth of the schema.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.operators import governance as G
from curata.operators.rules import Field
from curata.plans.storage import materialize

FOUND = "array<struct<path:string,keyword:string>>"
SAYS_NOTHING = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "format"}
CHECKS = {
    "$ref", "type", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "uniqueItems",
    "not", "allOf", "anyOf", "oneOf",
}
ROOT = "<root>"
Path = tuple["str | Column", ...]


def read_schema(spark: SparkSession, path: str) -> dict:
    """A schema file from wherever Spark reads."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one schema file")
    return json.loads(rows[0][0])


def json_type(v: Column) -> Column:
    """string, int, number, boolean, array, object or null of a VARIANT; null for what is absent."""
    t = F.schema_of_variant(v)
    return (
        F.when(t == "STRING", "string").when(t == "BIGINT", "int").when(t == "BOOLEAN", "boolean").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object")
        .when(t == "VOID", "null").when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "number")
    )


def nothing() -> Column:
    return F.array().cast(FOUND)


def said(path: Path, keyword: str) -> Column:
    steps: list[Column] = []
    for p in path:
        steps += [F.lit("."), F.lit(p) if isinstance(p, str) else p]
    return F.struct((F.concat(*steps[1:]) if steps else F.lit(ROOT)).alias("path"), F.lit(keyword).alias("keyword"))


class Value:
    """A VARIANT with its type, and its text, number and length where it has them."""

    def __init__(self, v: Column) -> None:
        self.v, self.type = v, json_type(v)
        self.text = F.when(self.type == "string", F.try_variant_get(v, "$", "string"))
        self.number = F.when(self.type.isin("int", "number"), F.try_variant_get(v, "$", "double"))
        self.size = F.when(self.type == "array", F.size(F.try_variant_get(v, "$", "array<variant>")))


def equals(x: object, value: Value) -> Column:
    if x is None:
        return value.type == "null"
    if isinstance(x, bool):
        return (value.type == "boolean") & (F.try_variant_get(value.v, "$", "boolean") == x)
    if isinstance(x, int | float):
        return value.number == float(x)
    if isinstance(x, str):
        return value.text == x
    return F.to_json(value.v) == F.to_json(F.parse_json(F.lit(json.dumps(x))))


class Compiler:
    def __init__(self, schema: Mapping) -> None:
        self.schema = schema

    def resolve(self, ref: str) -> Mapping | bool:
        at: object = self.schema
        if not ref.startswith("#/"):
            raise ValueError(f"only references within the file: {ref}")
        for step in ref[2:].split("/"):
            if not isinstance(at, Mapping) or step not in at:
                raise ValueError(f"nothing at {ref}")
            at = at[step]
        return at

    def findings(self, node: Mapping | bool, v: Column, path: Path, within: tuple[str, ...] = ()) -> Column:
        """The findings of the value v, which is not absent, against a schema node."""
        if isinstance(node, bool):
            return nothing() if node else F.array(said(path, "false"))
        if odd := [k for k in node if k not in CHECKS | SAYS_NOTHING and not k.endswith("_version")]:
            raise ValueError(f"keywords that are not supported: {', '.join(odd)}")
        parts: list[Column] = []
        if ref := node.get("$ref"):
            if ref in within:
                raise ValueError(f"{ref} holds itself: no expression of fixed depth")
            parts.append(self.findings(self.resolve(ref), v, path, (*within, ref)))
        value = Value(v)
        alone = [(k, c) for k in node if (c := self.check(node, k, value, within)) is not None]
        if alone:
            parts.append(F.filter(F.array(*[F.when(c, said(path, k)) for k, c in alone]), lambda x: x.isNotNull()))
        parts += self.of_object(node, v, path, within) + self.of_array(node, v, path, within)
        for sub in node.get("allOf", ()):
            parts.append(self.findings(sub, v, path, within))
        return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else nothing()

    def check(self, node: Mapping, keyword: str, value: Value, within: tuple[str, ...]) -> Column | None:
        """Whether the value breaks a keyword that looks at it as a whole."""
        if keyword not in CHECKS:
            return None
        want, v, t, text, number = node[keyword], value.v, value.type, value.text, value.number
        passes = lambda subs: sum((F.when(F.size(self.findings(s, v, (), within)) == 0, 1).otherwise(0) for s in subs), F.lit(0))
        match keyword:
            case "type":
                one = {"integer": (t == "int") | (F.coalesce(number == F.floor(number), F.lit(False))), "number": t.isin("int", "number")}
                ok = F.lit(False)
                for name in [want] if isinstance(want, str) else want:
                    ok = ok | one.get(name, t == name)
                return ~ok
            case "enum" | "const":
                ok = F.lit(False)
                for x in want if keyword == "enum" else [want]:
                    ok = ok | equals(x, value)
                return ~F.coalesce(ok, F.lit(False))
            case "pattern":
                return ~text.rlike(want)
            case "minLength":
                return F.length(text) < want
            case "maxLength":
                return F.length(text) > want
            case "minimum":
                return number < want
            case "maximum":
                return number > want
            case "exclusiveMinimum":
                return number <= want
            case "exclusiveMaximum":
                return number >= want
            case "minItems":
                return value.size < want
            case "maxItems":
                return value.size > want
            case "uniqueItems":
                items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x))
                return (t == "array") & (F.size(F.array_distinct(items)) < F.size(items)) if want else None
            case "not":
                return F.size(self.findings(want, v, (), within)) == 0
            case "anyOf":
                return passes(want) == 0
            case "oneOf":
                return passes(want) != 1
        return None

    def of_object(self, node: Mapping, v: Column, path: Path, within: tuple[str, ...]) -> list[Column]:
        known, need, extra = node.get("properties", {}), node.get("required", ()), node.get("additionalProperties", True)
        if not known and not need and extra is True:
            return []
        fields = F.try_variant_get(v, "$", "map<string,variant>")  # null for what is no object
        names, out = F.map_keys(fields), []
        of = lambda a: F.coalesce(a, nothing())
        if need:
            out.append(of(F.transform(F.array_except(F.array(*map(F.lit, need)), names), lambda k: said((*path, k), "required"))))
        for name, sub in known.items():
            child = F.try_element_at(fields, F.lit(name)) if set("'\\") & set(name) else F.try_variant_get(v, f"$['{name}']", "variant")
            out.append(of(F.when(child.isNotNull(), self.findings(sub, child, (*path, name), within))))
        if extra is not True:
            others = F.array_sort(F.array_except(names, F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")))
            if extra is False:
                out.append(of(F.transform(others, lambda k: said((*path, k), "additionalProperties"))))
            else:
                out.append(of(F.flatten(F.transform(others, lambda k: self.findings(extra, F.element_at(fields, k), (*path, k), within)))))
        return out

    def of_array(self, node: Mapping, v: Column, path: Path, within: tuple[str, ...]) -> list[Column]:
        if "items" not in node:
            return []
        items = F.try_variant_get(v, "$", "array<variant>")
        return [F.coalesce(F.flatten(F.transform(items, lambda x, i: self.findings(node["items"], x, (*path, i.cast("string")), within))), nothing())]


def findings(raw: Column, schema: Mapping) -> Column:
    """The array of struct(path, keyword) of a JSON text; what is no JSON has one finding, json. A null text as well."""
    return findings_of(F.try_parse_json(raw), schema)


def findings_of(v: Column, schema: Mapping) -> Column:
    """The same of a VARIANT. It is looked at many times: give it a column that has been parsed in a step before."""
    return F.when(v.isNull(), F.array(said((), "json"))).otherwise(Compiler(schema).findings(schema, v, ()))


def schema_findings(df: DataFrame, index: str, raw: str, schema: Mapping) -> DataFrame:
    """record_index, path, keyword of each finding of each record. One pass, no shuffle."""
    parsed = df.select(F.col(index).alias("record_index"), F.try_parse_json(F.col(raw)).alias("v"))
    return parsed.select("record_index", F.explode(findings_of(F.col("v"), schema)).alias("f")).select("record_index", "f.path", "f.keyword")


def annotation_findings(
    df: DataFrame, raw: str, schema: Mapping, typed: T.StructType, generated: Column | None = None, known_refs: DataFrame | None = None, artifact_images: DataFrame | None = None, verified_refs: DataFrame | None = None
) -> DataFrame:
    """id, rule, what of annotations as JSON texts: N1 of the schema and N17 of generated ones; only records with neither go to the other rules, which take a record's structure for granted.

    typed: the columns of governance.annotation_problems; generated: an array of reasons over them. The id is the record's own annotation_id where that can be read. The checked records are written once.
    """
    parsed = df.select(F.try_parse_json(F.col(raw)).alias("__v"), F.from_json(F.col(raw), typed).alias("__a"))
    read = parsed.select(findings_of(F.col("__v"), schema).alias("__found"), "__a")
    flat = read.select("__found", *[F.col(f"__a.`{n}`").alias(n) for n in typed.names])
    why = F.coalesce(generated, F.array().cast("array<string>")) if generated is not None else F.array().cast("array<string>")
    checked = materialize(flat.withColumn("__why", why), "annotations")
    ident = F.col("annotation_id").alias("id")
    broken = checked.select(ident, F.lit("N1").alias("rule"), F.explode(F.transform("__found", lambda f: F.concat_ws(" ", f["path"], f["keyword"]))).alias("what"))
    made = checked.where(F.size("__why") > 0).select(ident, F.lit("N17").alias("rule"), F.array_join("__why", ",").alias("what"))
    sound = checked.where((F.size("__found") == 0) & (F.size("__why") == 0)).drop("__found", "__why")
    return broken.unionByName(made).unionByName(G.annotation_problems(sound, known_refs, artifact_images, verified_refs))


def fields_of(schema: Mapping) -> list[Field]:
    """The schema's fields in its order, with the kind that a table of cells needs: array_obj and array_str, int, else string."""
    compiler, need, out = Compiler(schema), set(schema.get("required", ())), []

    def plain(node: Mapping) -> Mapping:
        return {**compiler.resolve(node["$ref"]), **{k: x for k, x in node.items() if k != "$ref"}} if "$ref" in node else node

    for name, node in schema["properties"].items():
        node = plain(node)
        kinds = node.get("type", ())
        kinds = [kinds] if isinstance(kinds, str) else list(kinds)
        kind = "string"
        if "array" in kinds:
            kind = "array_obj" if plain(node.get("items", {})).get("type") == "object" else "array_str"
        elif "integer" in kinds:
            kind = "int"
        texts: Sequence[str] = [x for x in node.get("enum", ()) if isinstance(x, str)]
        out.append(Field(name, kind, name in need, "null" in kinds, tuple(texts), node.get("pattern", ""), node.get("minimum"), node.get("maximum"), node.get("not") == {"const": 0}, node.get("minItems", 0)))
    return out
