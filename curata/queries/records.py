"""Record rules on JSON records built from documents, and on events' properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.operators import rules as R
from curata.operators.rules import Field
from curata.queries._registry import query, table
from curata.sources.records import from_cells, to_cells

PROPS = [Field("k", "int", required=True, low=0, high=80)]


@query("""
WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, list_contains(json_keys(props), 'k') AS here FROM events)
SELECT 'E1' AS rule, 'error' AS severity, 'k' AS field, event_id AS record_index FROM e WHERE NOT here OR k < 0 OR k > 80
""")
def props_rules(spark: SparkSession, d: str) -> DataFrame:
    found = R.record_findings(table(spark, d, "events"), "event_id", "props", PROPS)
    return found.where("rule = 'E1'")


@query("SELECT event_id, array_to_string(list_sort([x FOR x IN json_keys(props) IF x NOT IN ('id', 'name')]), ',') AS unknown FROM events")
def json_unknown_fields(spark: SparkSession, d: str) -> DataFrame:
    from curata.functions.absence import unknown_fields

    return table(spark, d, "events").select("event_id", F.array_join(unknown_fields(F.col("props"), ["id", "name"]), ",").alias("unknown"))


FIELDS = [
    Field("image_id", required=True, pattern="^[A-Za-z0-9][A-Za-z0-9_.-]{2,127}$"), Field("script_type", required=True, enum=("a", "b", "none", "other_script")), Field("inscription_present", enum=("yes", "no")),
    Field("image_path"), Field("split"), Field("split_exclusion_reason"), Field("label_source"), Field("dating_lower_year", "int", nullable=True, low=-3000, high=2100, not_zero=True),
    Field("dating_upper_year", "int", nullable=True, low=-3000, high=2100, not_zero=True), Field("dating_source"), Field("dating_basis", "array_str", enum=("stratigraphy", "style"), min_items=1), Field("notes", "array_str"), Field("context_reliability"),
]


def raw_records(spark: SparkSession, d: str) -> DataFrame:
    """A JSON record a document; which faults it has follows from its id."""
    i = F.col("doc_id")
    has = lambda n, v: F.when(i % n == 0, v)
    record = F.struct(
        F.concat(F.lit("img"), i.cast("string")).alias("image_id"), F.when(i % 5 == 0, "none").when(i % 7 == 0, "other_script").otherwise("a").alias("script_type"), F.when(i % 6 == 0, "no").otherwise("yes").alias("inscription_present"),
        F.when(i % 19 == 0, "../x.jpg").when(i % 23 == 0, "/abs.jpg").otherwise("a/b.jpg").alias("image_path"), F.when(i % 11 == 0, "excluded").when(i % 4 == 0, "test").otherwise("train").alias("split"), has(3, F.lit("project_annotation_unverified")).alias("label_source"),
        (i % 300 - 150).alias("dating_lower_year"), F.lit(50).alias("dating_upper_year"), has(2, F.lit("a book")).alias("dating_source"), has(9, F.array(F.lit("stratigraphy"))).alias("dating_basis"), has(29, F.lit("typo")).alias("extra_field"),
    )
    return table(spark, d, "documents").select("doc_id", F.to_json(record).alias("raw"))


@query("""
WITH d AS (SELECT doc_id AS i, CASE WHEN doc_id % 5 = 0 THEN 'none' WHEN doc_id % 7 = 0 THEN 'other_script' ELSE 'a' END AS script, CASE WHEN doc_id % 11 = 0 THEN 'excluded' WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, doc_id % 300 - 150 AS low FROM documents)
SELECT 'E1' AS rule, 'error' AS severity, 'extra_field' AS field, i AS record_index FROM d WHERE i % 29 = 0
UNION ALL SELECT 'E1', 'error', 'dating_lower_year', i FROM d WHERE low = 0
UNION ALL SELECT 'E3', 'error', 'image_path', i FROM d WHERE i % 19 = 0 OR i % 23 = 0
UNION ALL SELECT 'R5', 'error', 'script_type', i FROM d WHERE i % 6 = 0 AND script <> 'none'
UNION ALL SELECT 'R7', 'error', 'script_type_other_detail', i FROM d WHERE script = 'other_script'
UNION ALL SELECT 'R8', 'error', 'dating_lower_year', i FROM d WHERE low > 50
UNION ALL SELECT 'R9', 'error', 'dating_source', i FROM d WHERE i % 2 <> 0
UNION ALL SELECT 'R10', 'error', 'context_reliability', i FROM d WHERE i % 9 = 0
UNION ALL SELECT 'R12', 'error', 'split_exclusion_reason', i FROM d WHERE split = 'excluded'
UNION ALL SELECT 'R14', 'warning', 'label_source', i FROM d WHERE split = 'test' AND i % 3 = 0
""")
def record_rules(spark: SparkSession, d: str) -> DataFrame:
    found = R.record_findings(raw_records(spark, d), "doc_id", "raw", FIELDS)
    return found.where("rule <> 'R15'")


@query("""
WITH f AS (SELECT unnest(['image_sha256', 'view', 'source_reference', 'site', 'context_reliability', 'artifact_type', 'pottery_type', 'label_confidence', 'inscription_technique', 'reading_status', 'dating_text', 'dating_basis', 'dating_reliability', 'publication', 'annotator', 'annotation_date']) AS field)
SELECT field, count(*) AS n FROM f, documents WHERE NOT (field = 'dating_basis' AND doc_id % 9 = 0) GROUP BY field
""")
def recommended_absent(spark: SparkSession, d: str) -> DataFrame:
    """R15 by field."""
    found = R.record_findings(raw_records(spark, d), "doc_id", "raw")
    return found.where("rule = 'R15'").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH d AS (SELECT doc_id AS i, CASE WHEN doc_id % 5 = 0 THEN 'none' WHEN doc_id % 7 = 0 THEN 'other_script' ELSE 'a' END AS script, CASE WHEN doc_id % 11 = 0 THEN 'excluded' WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, doc_id % 300 - 150 AS low FROM documents),
n AS (SELECT sum(CAST(i % 29 = 0 AS INT) + CAST(low = 0 AS INT) + CAST(i % 19 = 0 OR i % 23 = 0 AS INT) + CAST(i % 6 = 0 AND script <> 'none' AS INT) + CAST(script = 'other_script' AS INT) + CAST(low > 50 AS INT) + CAST(i % 2 <> 0 AS INT) + CAST(i % 9 = 0 AS INT) + CAST(split = 'excluded' AS INT)) AS e,
  sum(CAST(split = 'test' AND i % 3 = 0 AS INT) + 16 - CAST(i % 9 = 0 AS INT)) AS w FROM d)
SELECT CAST(e AS BIGINT) AS n_errors, CAST(w AS BIGINT) AS n_warnings, e = 0 AS ok FROM n
""")
def validation_verdict(spark: SparkSession, d: str) -> DataFrame:
    return R.verdict(R.record_findings(raw_records(spark, d), "doc_id", "raw", FIELDS))


@query("SELECT doc_id, true AS same FROM documents")
def csv_codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Records to CSV cells and back: the same JSON, keys sorted."""
    fields = [*FIELDS, Field("extra_field")]
    r = raw_records(spark, d).withColumn("v", F.parse_json("raw"))
    cells = r.select("doc_id", F.to_json("v").alias("before"), *to_cells(F.col("raw"), F.col("v"), fields))
    return cells.select("doc_id", (F.to_json(F.parse_json(from_cells(fields))) == F.col("before")).alias("same"))
