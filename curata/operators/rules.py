"""Record rules as one projection: raw JSON records in, findings (rule, severity, field) out.

Records stay raw text beside typed fields, so absent, null and sentinel stay apart. A schema is a list of Field; its conformance rule
(E1) is generated. One record's findings are one array, exploded; only the rules over several records need a shuffle (operators.identity).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import absence as A
from curata.functions import scalars as S

# Fields that a record should have, and the reading fields that must say not_applicable without a script.
RECOMMENDED = (
    "image_sha256", "view", "source_reference", "site", "context_reliability", "artifact_type", "pottery_type", "label_confidence", "inscription_technique", "reading_status",
    "dating_text", "dating_basis", "dating_reliability", "publication", "annotator", "annotation_date",
)
READING = ("transcription", "transliteration", "translation_en", "translation_ta")


@dataclass(frozen=True)
class Field:
    """kind: string, int, number, boolean, array_str or array_obj. A string is never empty."""

    name: str
    kind: str = "string"
    required: bool = False
    nullable: bool = False
    enum: tuple[str, ...] = ()
    pattern: str = ""
    low: float | None = None
    high: float | None = None
    not_zero: bool = False
    min_items: int = 0


def _value(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _type(v: Column, name: str) -> Column:
    """Type of a field's value: string, int (whole JSON numbers as well), number, boolean, array, object or null; null if absent."""
    t = F.schema_of_variant(F.variant_get(v, f"$.{name}", "variant"))
    return (
        F.when(t == "STRING", "string").when(t == "BIGINT", "int").when(t == "BOOLEAN", "boolean").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object")
        .when(t == "VOID", "null").when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "number")
    )


def schema_problems(raw: Column, variant: Column, fields: Sequence[Field]) -> Column:
    """E1: array of struct(rule, severity, field) for missing, unknown, mistyped, out-of-domain, out-of-range fields."""
    finding = lambda field: F.struct(F.lit("E1").alias("rule"), F.lit("error").alias("severity"), field.alias("field"))
    missing = F.transform(A.missing_fields(raw, [f.name for f in fields if f.required]), finding)
    unknown = F.transform(F.coalesce(A.unknown_fields(raw, [f.name for f in fields]), F.array().cast("array<string>")), finding)
    one = []
    for f in fields:
        here, t = A.is_present(raw, f.name), _type(variant, f.name)
        text, number = _value(variant, f.name, "string"), _value(variant, f.name, "double")
        if f.kind == "string":
            bad = (t != "string") | (text == "")
            if f.enum:
                bad = bad | ~text.isin(*f.enum)
            if f.pattern:
                bad = bad | ~text.rlike(f.pattern)
        elif f.kind in ("int", "number"):
            ok = t.isin("int", "number") if f.kind == "number" else (t == "int") | ((t == "number") & (number == F.floor(number)))
            bad = ~ok
            if f.low is not None:
                bad = bad | (number < f.low)
            if f.high is not None:
                bad = bad | (number > f.high)
            if f.not_zero:
                bad = bad | (number == 0)
        elif f.kind == "boolean":
            bad = t != "boolean"
        else:
            bad = t != "array"
            if f.min_items:
                bad = bad | (F.size(_value(variant, f.name, "array<variant>")) < f.min_items)
            if f.enum and f.kind == "array_str":
                bad = bad | (F.size(F.array_except(_value(variant, f.name, "array<string>"), F.array(*map(F.lit, f.enum)))) > 0)
        if f.nullable:
            bad = bad & (t != "null")
        one.append(F.when(here & F.coalesce(bad, F.lit(True)), F.lit(f.name)))
    values = F.transform(F.filter(F.array(*one), lambda x: x.isNotNull()), finding)
    return F.concat(missing, unknown, values)


def record_problems(raw: Column, v: Column, export_mode: bool = False, schema_major: str = "1") -> Column:
    """E3, E4, R5 to R15 of one record, as an array of struct(rule, severity, field)."""
    s = lambda n: F.when(_type(v, n) == "string", _value(v, n, "string"))
    whole = lambda n: F.when(_type(v, n) == "int", _value(v, n, "bigint"))  # noqa: E731  a number such as 5.0 is none
    has = lambda n: A.is_present(raw, n)
    path, script, low, high = F.nullif(s("image_path"), F.lit("")), s("script_type"), whole("dating_lower_year"), whole("dating_upper_year")
    basis = _value(v, "dating_basis", "array<string>")
    w, h = whole("image_width_px"), whole("image_height_px")
    problems = [(p, "E3", "error", "image_path", F.array_contains(S.path_problems(path), p)) for p in ("backslash", "absolute", "traversal")]
    checks = [
        *[(rule, sev, field, cond) for _, rule, sev, field, cond in problems],
        ("E4", "error", "schema_version", F.split_part(s("schema_version"), F.lit("."), F.lit(1)) != schema_major),
        ("R5", "error", "script_type", (s("inscription_present") == "no") & ~script.eqNullSafe(F.lit("none"))),
        *[("R6", "error", f, (script == "none") & has(f) & ~s(f).eqNullSafe(F.lit("not_applicable"))) for f in READING],
        ("R7", "error", "script_type_other_detail", (script == "other_script") & ~A.has_real_text(s("script_type_other_detail"))),
        ("R8", "error", "dating_lower_year", low > high),
        ("R9", "error", "dating_source", (low.isNotNull() | high.isNotNull()) & ~A.has_real_text(s("dating_source"))),
        ("R10", "error", "context_reliability", F.array_contains(basis, "stratigraphy") & ~s("context_reliability").eqNullSafe(F.lit("excavated_stratified"))),
        ("R11", "error", "redistributable", F.lit(export_mode) & ~s("redistributable").eqNullSafe(F.lit("yes"))),
        ("R12", "error", "split_exclusion_reason", (s("split") == "excluded") & ~A.has_real_text(s("split_exclusion_reason"))),
        ("R14", "warning", "label_source", (s("split") == "test") & (s("label_source") == "project_annotation_unverified")),
        *[("R15", "warning", f, ~has(f)) for f in RECOMMENDED],
    ]
    found = lambda rule, sev, field: F.struct(F.lit(rule).alias("rule"), F.lit(sev).alias("severity"), (field if isinstance(field, Column) else F.lit(field)).alias("field"))
    items = F.array(*[F.when(c, found(rule, sev, field)) for rule, sev, field, c in checks])
    # R13: one finding for each region that leaves the image; a number that is not written as a whole one is none
    regions = _value(v, "inscription_regions", "array<variant>")
    whole_of = lambda r, n: F.when(_type(r, n) == "int", _value(r, n, "bigint"))
    beyond = lambda r: (whole_of(r, "x") + whole_of(r, "w") > w) | (whole_of(r, "y") + whole_of(r, "h") > h)
    sides = lambda r: (whole_of(r, "x") + whole_of(r, "y") + whole_of(r, "w") + whole_of(r, "h")).isNotNull()
    outside = F.transform(regions, lambda r, i: F.when(sides(r) & beyond(r), found("R13", "error", F.concat(F.lit("inscription_regions."), i.cast("string")))))
    return F.filter(F.concat(items, F.coalesce(outside, F.array().cast("array<struct<rule:string,severity:string,field:string>>"))), lambda x: x.isNotNull())


def record_findings(df: DataFrame, index: str, raw: str, fields: Sequence[Field] = (), export_mode: bool = False) -> DataFrame:
    """rule, severity, field, record_index for each finding of each record. A line that is no JSON object is one E1 finding without a field."""
    v = F.try_parse_json(F.col(raw))
    parsed = df.select(F.col(index).alias("record_index"), F.col(raw).alias("raw"), v.alias("v"), F.json_object_keys(F.col(raw)).alias("k"))
    ok = F.col("v").isNotNull() & F.col("k").isNotNull()
    found = record_problems(F.col("raw"), F.col("v"), export_mode)
    if fields:
        found = F.concat(schema_problems(F.col("raw"), F.col("v"), fields), found)
    broken = F.array(F.struct(F.lit("E1").alias("rule"), F.lit("error").alias("severity"), F.lit(None).cast("string").alias("field")))
    return parsed.select("record_index", F.explode(F.when(ok, found).otherwise(broken)).alias("f")).select("f.rule", "f.severity", "f.field", "record_index")


def missing_files(df: DataFrame, index: str, path: str, files: DataFrame) -> DataFrame:
    """R2: records whose path is not among files (column path)."""
    return df.where(F.coalesce(F.col(path), F.lit("")) != "").join(files.select(F.col("path").alias(path)).distinct(), path, "left_anti").select(F.lit("R2").alias("rule"), F.col(index).alias("record_index"))


def hash_mismatches(df: DataFrame, index: str, path: str, digest: str, files: DataFrame) -> DataFrame:
    """E2: records whose real digest is not that of their file (files: path, sha256)."""
    j = df.where(A.has_real_text(F.col(digest))).join(files.select(F.col("path").alias(path), F.col("sha256").alias("__h")), path)
    return j.where(F.col("__h") != F.col(digest)).select(F.lit("E2").alias("rule"), F.col(index).alias("record_index"))


def verdict(findings: DataFrame, strict: bool = False) -> DataFrame:
    """One row: n_errors, n_warnings, ok; no findings are ok."""
    e, w = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")
    return findings.agg(e.alias("n_errors"), w.alias("n_warnings")).withColumn("ok", (F.col("n_errors") == 0) & (~F.lit(strict) | (F.col("n_warnings") == 0)))


def sort_findings(findings: DataFrame) -> DataFrame:
    """By record (dataset-wide ones last), then rule as text, so that R10 stands before R2."""
    return findings.orderBy(F.coalesce("record_index", F.lit(2**30)), "rule", F.coalesce("field", F.lit("")))
