"""Schema files over nested records: events as records that break a schema by their numbers, and documents as annotations of which some are broken before the other rules see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.operators import governance as G
from curata.operators import schema as S
from curata.queries._registry import query, table
from curata.queries.governance import annotation_sql, annotations

EVENT_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["id", "kind", "value", "parts"],
    "$defs": {
        "code": {"type": "string", "pattern": "^[a-z]+$", "maxLength": 8},
        "year": {"type": ["integer", "null"], "minimum": -3000, "maximum": 2100, "not": {"const": 0}},
        "part": {"type": "object", "required": ["at"], "additionalProperties": False, "properties": {"at": {"type": "number", "exclusiveMinimum": 0, "maximum": 1}, "years": {"type": "array", "maxItems": 2, "items": {"$ref": "#/$defs/year"}}}},
    },
    "properties": {
        "id": {"type": "integer", "minimum": 0},
        "kind": {"$ref": "#/$defs/code", "enum": ["click", "view", "purchase", "signup", "error"]},
        "value": {"anyOf": [{"type": "number", "minimum": 0}, {"const": "unknown"}]},
        "parts": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"$ref": "#/$defs/part"}},
        "ok": {"type": "boolean"},
    },
}


def event_records(spark: SparkSession, d: str) -> DataFrame:
    """event_id, raw: JSON written by hand, so that absent, null and odd values are what they are."""
    k = F.col("event_id")
    one = lambda cond, yes, no: F.when(cond, F.lit(yes)).otherwise(no if not isinstance(no, str) else F.lit(no))
    number = F.concat(F.col("user_id").cast("string"), F.lit(".5"))
    fields = [
        F.concat(F.lit('"id": '), one(k % 11 == 3, "-1", one(k % 11 == 4, "2.5", one(k % 11 == 5, "7.0", k.cast("string"))))),
        F.when(k % 13 != 1, F.concat(F.lit('"kind": "'), one(k % 13 == 2, "UNKNOWN KIND", F.col("event_type")), F.lit('"'))),
        F.concat(F.lit('"value": '), one(k % 7 == 1, "null", one(k % 7 == 2, '"unknown"', one(k % 7 == 3, '"?"', one(k % 7 == 4, "-1", number))))),
        F.concat(
            F.lit('"parts": '),
            one(k % 5 == 1, "[]", one(k % 5 == 2, '[{"at": 0.5, "years": [0, null, 3000]}, {"at": 0, "x": 1}]', one(k % 5 == 3, '[{"at": 1}, {"at": 1}, {"years": ["1"]}]', one(k % 5 == 4, '{"at": 1}', '[{"at": 0.25, "years": [-200, 100.0]}]')))),
        ),
        F.when(k % 17 == 0, F.lit('"ok": "yes"')),
        F.when(k % 19 == 0, F.lit('"more": {}')),
    ]
    whole = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ", "), F.lit("}"))
    return table(spark, d, "events").select("event_id", F.when(k % 101 == 100, F.lit("{broken")).when(k % 101 == 99, F.lit("[1]")).otherwise(whole).alias("raw"))


@query("""
WITH e AS (SELECT event_id AS k, event_type FROM events), r AS (SELECT * FROM e WHERE k % 101 < 99)
SELECT k AS record_index, '<root>' AS path, 'json' AS keyword FROM e WHERE k % 101 = 100
UNION ALL SELECT k, '<root>', 'type' FROM e WHERE k % 101 = 99
UNION ALL SELECT k, 'kind', 'required' FROM r WHERE k % 13 = 1
UNION ALL SELECT k, 'id', 'minimum' FROM r WHERE k % 11 = 3 UNION ALL SELECT k, 'id', 'type' FROM r WHERE k % 11 = 4
UNION ALL SELECT k, 'kind', unnest(['enum', 'pattern', 'maxLength']) FROM r WHERE k % 13 = 2
UNION ALL SELECT k, 'value', 'anyOf' FROM r WHERE k % 7 IN (1, 3, 4)
UNION ALL SELECT k, 'parts', 'minItems' FROM r WHERE k % 5 = 1
UNION ALL SELECT k, 'parts.0.years', 'maxItems' FROM r WHERE k % 5 = 2 UNION ALL SELECT k, 'parts.0.years.0', 'not' FROM r WHERE k % 5 = 2 UNION ALL SELECT k, 'parts.0.years.2', 'maximum' FROM r WHERE k % 5 = 2
UNION ALL SELECT k, 'parts.1.at', 'exclusiveMinimum' FROM r WHERE k % 5 = 2 UNION ALL SELECT k, 'parts.1.x', 'additionalProperties' FROM r WHERE k % 5 = 2
UNION ALL SELECT k, 'parts', 'uniqueItems' FROM r WHERE k % 5 = 3 UNION ALL SELECT k, 'parts.2.at', 'required' FROM r WHERE k % 5 = 3 UNION ALL SELECT k, 'parts.2.years.0', 'type' FROM r WHERE k % 5 = 3
UNION ALL SELECT k, 'parts', 'type' FROM r WHERE k % 5 = 4
UNION ALL SELECT k, 'ok', 'type' FROM r WHERE k % 17 = 0 UNION ALL SELECT k, 'more', 'additionalProperties' FROM r WHERE k % 19 = 0
""")
def schema_findings(spark: SparkSession, d: str) -> DataFrame:
    return S.schema_findings(event_records(spark, d), "event_id", "raw", EVENT_SCHEMA)


ANNOTATION_SCHEMA = {
    "type": "object",
    "required": ["annotation_id", "image_ids", "provenance_type", "inscription", "dating", "references"],
    "$defs": {"text": {"type": "string", "minLength": 1}, "side": {"type": "number", "minimum": 0, "maximum": 1}},
    "properties": {
        "annotation_id": {"$ref": "#/$defs/text"},
        "image_ids": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/text"}},
        "provenance_type": {"enum": list(G.ROLE)},
        "inscription": {
            "type": "object", "required": ["inscription_present", "script_type", "regions"],
            "properties": {"regions": {"type": "array", "items": {"type": "object", "required": ["image_id", "x", "y"], "properties": {n: {"$ref": "#/$defs/side"} for n in ("x", "y", "width", "height")}}}},
        },
        "dating": {"type": "object", "properties": {"estimated_start_year": {"type": ["integer", "null"], "not": {"const": 0}}}},
    },
}


@query(f"""
WITH {annotation_sql("k % 23 <> 1 AND k % 23 <> 2 AND k % 29 <> 3 AND k % 31 <> 4")},
every AS (SELECT doc_id AS k, CAST(doc_id AS VARCHAR) AS id FROM documents), twice AS (SELECT every.* FROM every, (SELECT unnest([0, 1]) AS c) WHERE c = 0 OR k % 50 = 7)
SELECT id, rule, what FROM p
UNION ALL SELECT id, 'N1', 'image_ids type' FROM twice WHERE k % 23 = 1 UNION ALL SELECT id, 'N1', 'image_ids minItems' FROM twice WHERE k % 23 = 2
UNION ALL SELECT id, 'N1', 'dating.estimated_start_year not' FROM twice WHERE k % 29 = 3 UNION ALL SELECT id, 'N17', 'image_ids' FROM twice WHERE k % 31 = 4 AND k % 23 <> 1 AND k % 23 <> 2
""")
def annotation_schema(spark: SparkSession, d: str) -> DataFrame:
    """Annotations as JSON texts, some of them broken or of generated images: those have N1 or N17 and no other rule's findings."""
    typed = annotations(spark, d)
    k = F.col("annotation_id").cast("long")
    raw = typed.select(k.alias("k"), F.to_json(F.struct(*typed.columns)).alias("raw"))
    k = F.col("k")
    raw = raw.select(
        F.when(k % 23 == 1, F.regexp_replace("raw", r'"image_ids":\[[^\]]*\]', '"image_ids":"i"')).when(k % 23 == 2, F.regexp_replace("raw", r'"image_ids":\[[^\]]*\]', '"image_ids":[]'))
        .otherwise(F.col("raw")).alias("raw"), "k")
    raw = raw.select(F.when(k % 29 == 3, F.regexp_replace("raw", '"estimated_start_year":100', '"estimated_start_year":0')).otherwise(F.col("raw")).alias("raw"), "k")
    raw = raw.select(F.when((k % 31 == 4) & (k % 23 != 1) & (k % 23 != 2), F.regexp_replace("raw", r'"image_ids":\["[ij]"', '"image_ids":["SYN-1"')).otherwise(F.col("raw")).alias("raw"))
    generated = G.synthetic_reasons("SYN", "generator", "generated", ["task"], "generated", ["image_ids", "artifact_id"])
    return S.annotation_findings(raw, "raw", ANNOTATION_SCHEMA, typed.schema, generated)
