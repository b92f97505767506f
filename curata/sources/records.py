"""Records in and out: JSON lines with line numbers, CSV with a typed cell codec, registries, manifests, file scans."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions.scalars import safe_cell
from curata.operators.rules import Field

NULL_CELL, EMPTY_CELL = "null", "[]"


def read_jsonl(spark: SparkSession, path: str, fail: bool = True) -> DataFrame:
    """raw lines with file, whether they parse, blank ones left out. With fail, a line that is no JSON raises as it is read, naming its file and text."""
    lines = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file")).where(F.trim("raw") != "")
    ok = F.try_parse_json("raw").isNotNull()
    if not fail:
        return lines.withColumn("ok", ok)
    message = F.concat(F.col("file"), F.lit(": no JSON: "), F.substring("raw", 1, 80))
    return lines.withColumn("ok", F.when(ok, True).otherwise(F.raise_error(message).cast("boolean")))


def write_jsonl(records: DataFrame, path: str, fields: Sequence[str]) -> None:
    """JSON lines with keys in the order of fields, then the others sorted; nulls are left out."""
    extra = sorted(set(records.columns) - set(fields))
    names = [f for f in fields if f in records.columns] + extra
    records.select(F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])).alias("value")).write.text(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text; a byte-order mark is no part of the first name."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', nullValue="\x00none", emptyValue="")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def write_csv(df: DataFrame, path: str, fields: Sequence[str], guard: bool = False) -> None:
    """Columns in the order of fields; a column that is none of them is an error. guard keeps spreadsheets from reading cells as formulas."""
    if extra := sorted(set(df.columns) - set(fields)):
        raise ValueError(f"columns that are not in the schema: {extra}")
    cells = [(safe_cell(F.col(f"`{f}`")) if guard else F.col(f"`{f}`")).alias(f) for f in fields]
    df.select(*cells).write.csv(path, header=True, escape='"', emptyValue="", nullValue="")


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """By extension: .jsonl, .csv, or .json (an object or an array of objects)."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path)
    if path.endswith(".csv"):
        return read_csv(spark, path)
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"))
        items = F.when(F.col("value").startswith("["), F.expr("from_json(value, 'array<variant>')")).otherwise(F.array(F.parse_json("value")))
        return whole.select(F.explode(items).alias("v"), "file").select(F.to_json("v").alias("raw"), "file", F.lit(True).alias("ok"))
    raise ValueError(f"{path}: neither .jsonl nor .csv nor .json")


def to_cells(raw: Column, variant: Column, fields: Sequence[Field]) -> list[Column]:
    """A record's CSV cells: absent is empty, null and [] have names, enumerated arrays join with semicolons, other arrays are JSON."""
    out = []
    for f in fields:
        value = F.variant_get(variant, f"$.{f.name}", "variant")
        text = F.try_variant_get(variant, f"$.{f.name}", "string")
        if f.kind == "array_str" and f.enum:
            items = F.try_variant_get(variant, f"$.{f.name}", "array<string>")
            cell = F.when(F.size(items) == 0, EMPTY_CELL).otherwise(F.concat_ws(";", items))
        elif f.kind in ("array_str", "array_obj"):
            cell = F.to_json(value)
        else:
            cell = F.when(F.is_variant_null(value), NULL_CELL).otherwise(text) if f.kind != "string" else F.when(F.schema_of_variant(value) == "STRING", text).otherwise(F.to_json(value))
        out.append(F.when(value.isNull(), "").otherwise(cell).alias(f.name))
    return out


def from_cells(fields: Sequence[Field]) -> Column:
    """The record's JSON from its cells; empty cells are absent. A cell that does not fit its kind raises."""
    parts = []
    for f in fields:
        c = F.col(f"`{f.name}`")
        quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
        if f.kind in ("int", "number", "boolean"):
            number = F.trim(c).try_cast({"int": "bigint", "number": "double", "boolean": "boolean"}[f.kind])
            body = F.when(F.lower(F.trim(c)) == NULL_CELL, NULL_CELL).when(number.isNotNull(), number.cast("string")).otherwise(F.raise_error(F.concat(F.lit(f"{f.name}: not {f.kind}: "), c)).cast("string"))
        elif f.kind == "array_str" and f.enum:
            items = F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")
            body = F.when(c == EMPTY_CELL, EMPTY_CELL).otherwise(F.to_json(items))
        elif f.kind in ("array_str", "array_obj"):
            body = F.when(F.schema_of_variant(F.try_parse_json(c)).startswith("ARRAY"), F.to_json(F.try_parse_json(c))).otherwise(F.raise_error(F.concat(F.lit(f"{f.name}: no JSON array: "), c)).cast("string"))
        else:
            body = quoted(c)
        parts.append(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(json.dumps(f.name) + ":"), body)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def save_manifest(assignments: DataFrame, group: str, partition: str, path: str) -> str:
    """Writes assignments with their digest in a table beside; returns the digest."""
    digest = manifest_digest(assignments, group, partition)
    assignments.write.mode("overwrite").parquet(f"{path}/assignments")
    assignments.sparkSession.createDataFrame([(digest,)], "digest string").coalesce(1).write.mode("overwrite").json(f"{path}/digest")
    return digest


def manifest_digest(assignments: DataFrame, group: str, partition: str) -> str:
    """Order-free: a digest a row, then by buckets of ids, then one."""
    from curata.operators.identity import fingerprint

    row = F.concat_ws("\x1f", F.col(group).cast("string"), F.col(partition))
    return fingerprint(assignments, group, row, "manifest").first()["fingerprint"]


def load_manifest(spark: SparkSession, path: str, group: str, partition: str) -> DataFrame:
    """The assignments; raises if they are not what was saved."""
    found = spark.read.parquet(f"{path}/assignments")
    said = spark.read.json(f"{path}/digest").first()["digest"]
    if manifest_digest(found, group, partition) != said:
        raise ValueError(f"{path}: the assignments are not those that were saved")
    return found


def scan_files(spark: SparkSession, path: str, suffixes: Sequence[str] = ()) -> DataFrame:
    """path, suffix, length, modified, sha256 of files below a folder, read as a stream of binary rows."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    df = df.select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    return df.where(F.col("suffix").isin(*suffixes)) if suffixes else df


def newest_file(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def latest_by_key(sidecars: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, that of the last by order."""
    rest = [c for c in sidecars.columns if c != key]
    return sidecars.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Predictions from JSON lines; one without an image_id, or that is no JSON, raises as it is read. ``schema`` names image_id among its columns."""
    rows = spark.read.schema(schema).json(path, mode="FAILFAST")
    missing = F.raise_error(F.lit("a prediction without image_id")).cast(rows.schema["image_id"].dataType)
    return rows.withColumn("image_id", F.when(F.col("image_id").isNotNull(), F.col("image_id")).otherwise(missing))


def export_annotations(current: DataFrame, path: str, tier: str, order: Sequence[str], fields: Sequence[str]) -> None:
    """Current annotations twice: whole as JSON lines with sorted keys, and as CSV in ``order``, the tier first and whether it is a prediction second, cells guarded, null and nested ones as text."""
    write_jsonl(current, f"{path}/annotations_current.jsonl", [])
    text = lambda f: F.coalesce(F.col(f).cast("string") if "struct" not in current.schema[f].dataType.simpleString() else F.to_json(f), F.lit(""))
    rows = current.orderBy(*order).select(F.col(tier).alias("provenance_tier"), (F.col(tier) == "ai_prediction").cast("string").alias("is_ai_output"), *[text(f).alias(f) for f in fields])
    write_csv(rows, f"{path}/annotations_current.csv", ["provenance_tier", "is_ai_output", *fields], guard=True)
