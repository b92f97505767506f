"""The rule families over typed tables made from documents and customers: what each row breaks follows from its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.operators import governance as G
from curata.queries._registry import query, table

KINDS = ["source_information", "project_annotation", "expert_annotation", "ai_prediction"]
NA, VERIFIED = "not_applicable", "verified_against_source"
STATUSES = [VERIFIED, "discrepancy_found", "source_unavailable", "unverified"]
REGION = "array<struct<image_id:string,x:double,y:double,width:double,height:double,label:string,sign_index:int>>"
EVIDENCE = "array<struct<evidence_id:string,evidence_type:string,supports_start_year:int,supports_end_year:int,association:string,source_reference:string>>"


def pick(k: Column, words: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """A document as an annotation, each fiftieth twice."""
    k, text = F.col("k"), lambda c: F.lit(c).cast("string")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("k")).withColumn("copy", F.explode(F.when(k % 50 == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    absent, kind = k % 6 == 0, pick(k, KINDS)
    region = F.array(F.struct(F.lit("i"), F.lit(0.5), F.lit(0.5), F.when(k % 9 == 0, 0.6).otherwise(0.4), F.lit(0.4), F.lit("text"), F.lit(None).cast("int"))).cast(REGION)
    evidence = F.array(F.struct(F.lit("e1"), F.lit("paleography"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit("x"), F.lit("r1"))).cast(EVIDENCE)
    reading = [
        F.when(absent, "no").otherwise("yes").alias("inscription_present"), F.when(absent & (k % 7 != 0), "none").otherwise("brahmi").alias("script_type"), F.when(absent, NA).otherwise("label").alias("inscription_type"),
        F.when(absent, NA).otherwise("ka").alias("reading"), F.when(~absent & (k % 13 != 0), "r1").alias("reading_source"), F.lit("high").alias("reading_confidence"), F.lit("high").alias("script_confidence"), F.lit("unknown").alias("reading_completeness"),
        F.when(absent, F.array().cast(REGION)).otherwise(region).alias("regions"),
    ]
    meaning = [F.lit("unknown").alias("interpretation_type"), *[text(None).alias(c) for c in ("translation", "translation_source", "translation_confidence")]]
    dating = [
        F.lit(100).alias("estimated_start_year"), F.when(k % 8 == 0, 50).otherwise(200).alias("estimated_end_year"), F.when(k % 10 == 0, F.array().cast(EVIDENCE)).otherwise(evidence).alias("dating_evidence"), F.array(F.lit("paleography")).alias("dating_basis"),
        F.lit("low").alias("dating_confidence"),
    ]
    cited = F.array(F.struct(F.lit("r1").alias("ref_id"), F.lit("unverified").alias("verification_status")))
    settles = F.struct(F.array(k.cast("string")).alias("resolves"), F.lit("agreed").alias("outcome"))
    return rows.select(
        k.cast("string").alias("annotation_id"), text("a").alias("artifact_id"), F.array(F.when(k % 17 == 0, "j").otherwise("i")).alias("image_ids"), kind.alias("provenance_type"),
        F.when(k % 11 == 0, "expert").otherwise(pick(k, [G.ROLE[x] for x in KINDS])).alias("role"), text(None).alias("qualification"), F.when(k % 5 == 0, "expert_reviewed").otherwise("unreviewed").alias("review_state"),
        F.struct(*reading).alias("inscription"), F.struct(*meaning).alias("interpretation"), F.struct(*dating).alias("dating"), F.when(k % 3 == 0, F.slice(cited, 1, 0)).otherwise(cited).alias("references"),
        F.array().cast("array<struct<image_id:string>>").alias("image_usability"), F.when(k % 28 == 2, settles).alias("adjudication"), (k % 19 == 0).alias("ai_marked"),
    )


def annotation_sql(kept: str = "true") -> str:
    """The findings p of the annotations whose number k is kept."""
    return f"""
k AS (SELECT doc_id AS k, CAST(doc_id AS VARCHAR) AS id, doc_id % 6 = 0 AS absent, doc_id % 4 AS kind FROM documents WHERE {kept.replace('k %', 'doc_id %')}),
r AS (SELECT k.* FROM k, (SELECT unnest([0, 1]) AS c) WHERE c = 0 OR k % 50 = 7),
p AS (
  SELECT id, 'N3' AS rule, 'region on another image' AS what FROM r WHERE NOT absent AND k % 17 = 0 UNION ALL SELECT id, 'N3', 'region beyond the image' FROM r WHERE NOT absent AND k % 9 = 0
  UNION ALL SELECT id, 'N4', 'role' FROM r WHERE k % 11 = 0 AND kind <> 2 UNION ALL SELECT id, 'N4', 'expert_reviewed is for experts' FROM r WHERE k % 5 = 0 AND kind <> 2 UNION ALL SELECT id, 'N4', 'predictions are unreviewed' FROM r WHERE k % 5 = 0 AND kind = 3
  UNION ALL SELECT id, 'N5', 'source information cites' FROM r WHERE kind = 0 AND k % 3 = 0 UNION ALL SELECT id, 'N6', 'absent needs script none' FROM r WHERE absent AND k % 7 = 0
  UNION ALL SELECT id, 'N7', 'reading without source' FROM r WHERE NOT absent AND k % 13 = 0 UNION ALL SELECT id, 'N9', 'range reversed' FROM r WHERE k % 8 = 0
  UNION ALL SELECT id, 'N9', unnest(['range without evidence', 'basis without evidence', 'basis names other evidence']) FROM r WHERE k % 10 = 0
  UNION ALL SELECT id, 'N15', 'marked as prepared by a model' FROM r WHERE k % 19 = 0 AND kind <> 3
  UNION ALL SELECT id, 'N18', unnest(['no qualification', 'resolves itself']) FROM r WHERE k % 28 = 2 UNION ALL SELECT id, 'N18', 'adjudicator is no expert' FROM r WHERE k % 28 = 2 AND k % 5 <> 0
  UNION ALL SELECT id, 'N10', 'cites what is not there' FROM k WHERE k % 3 = 0 AND (k % 10 <> 0 OR (NOT absent AND k % 13 <> 0)) UNION ALL SELECT id, 'N12', 'duplicate id' FROM k WHERE k % 50 = 7
)
"""


@query(f"WITH {annotation_sql()} SELECT id, rule, what FROM p")
def annotation_rules(spark: SparkSession, d: str) -> DataFrame:
    return G.annotation_problems(annotations(spark, d))


def reference_table(spark: SparkSession) -> DataFrame:
    """r0 to r6, but for r6's place: r0 and r1 verified, r4 without a citation, r5 a placeholder, r3 of an unknown status."""
    rows = [(f"r{i}", None if i == 4 else "book", VERIFIED if i < 2 else "perhaps" if i == 3 else "located" if i == 5 else "unverified", "unresolved" if i == 5 else "resolved", None) for i in range(6)]
    return spark.createDataFrame(rows, "id string, citation string, verification_status string, resolution string, candidate_works array<string>")


REFERENCES = f"refs AS (SELECT 'r' || i AS id, i, CASE WHEN i < 2 THEN '{VERIFIED}' WHEN i = 3 THEN 'perhaps' WHEN i = 5 THEN 'located' ELSE 'unverified' END AS status FROM (SELECT unnest(range(6)) AS i))"


@query(f"""
WITH {REFERENCES},
e AS (SELECT 'p' || p_partkey AS id, p_partkey AS k, p_partkey % 8 AS ref, p_partkey % 9 = 0 AS bare, CASE p_partkey % 3 WHEN 0 THEN '{VERIFIED}' WHEN 1 THEN 'unverified' ELSE 'perhaps' END AS status FROM part),
p AS (
  SELECT id, 'K2' AS rule, 'no citation' AS what FROM refs WHERE i = 4 UNION ALL SELECT id, 'K2', 'status' FROM refs WHERE i = 3 UNION ALL SELECT id, 'K8', unnest(['a placeholder is unverified', 'a placeholder lists candidates']) FROM refs WHERE i = 5
  UNION ALL SELECT id, 'K3', 'assertion without references' FROM e WHERE bare UNION ALL SELECT id, 'K4', 'status' FROM e WHERE k % 3 = 2
  UNION ALL SELECT id, 'K3', 'unknown reference' FROM e WHERE NOT bare AND ref > 5 UNION ALL SELECT id, 'K8', 'verified against a placeholder' FROM e WHERE NOT bare AND ref = 5 AND k % 3 = 0
  UNION ALL SELECT 'p' || p_partkey, 'K1', 'duplicate id' FROM part WHERE p_partkey % 40 = 3
)
SELECT DISTINCT id, rule, what FROM p
""")
def knowledge_rules(spark: SparkSession, d: str) -> DataFrame:
    """Parts as entries of one assertion each, each fortieth twice."""
    k = F.col("p_partkey")
    refs = F.when(k % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("r"), (k % 8).cast("string"))))
    one = F.array(F.struct(refs.alias("reference_ids"), pick(k, [VERIFIED, "unverified", "perhaps"]).alias("verification_status")))
    copies = F.explode(F.when(k % 40 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    entries = table(spark, d, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("id"), one.alias("assertions"), copies).drop("copy")
    return G.knowledge_problems(reference_table(spark), entries, [*STATUSES, "located"])


@query(f"""
WITH {REFERENCES},
b AS (SELECT c_custkey AS k, c_custkey % 7 AS ref, CASE WHEN c_custkey % 3 = 0 THEN 'text' ELSE 'c' || c_custkey % 4 END AS claim, c_custkey % 4 AS st, c_custkey % 10 = 0 OR (c_custkey % 4 = 2 AND c_custkey % 3 <> 0) AS away, c_custkey % 6 = 0 AS undated,
  CASE WHEN c_custkey % 13 = 0 THEN c_custkey - 1 WHEN c_custkey % 13 = 1 AND c_custkey > 1 THEN c_custkey - 2 WHEN c_custkey % 17 = 0 THEN -c_custkey END AS sup FROM customer),
p AS (
  SELECT k, 'V2' AS rule, 'unknown reference' AS what FROM b WHERE ref = 6 UNION ALL SELECT k, 'V9', 'an unresolved placeholder' FROM b WHERE ref = 5 AND st < 2 UNION ALL SELECT k, 'V3', 'in the future' FROM b WHERE NOT undated AND k % 11 = 0
  UNION ALL SELECT k, 'V3', 'verifier and role' FROM b WHERE st = 0 AND k % 5 = 0 UNION ALL SELECT k, 'V3', 'date' FROM b WHERE st = 0 AND undated UNION ALL SELECT k, 'V3', 'locator' FROM b WHERE st = 0 AND k % 8 = 0
  UNION ALL SELECT k, 'V3', 'source_location' FROM b WHERE st = 0 AND k % 9 = 0 UNION ALL SELECT k, 'V3', 'not accessed' FROM b WHERE st = 0 AND away UNION ALL SELECT k, 'V4', 'who, when and how' FROM b WHERE st = 1 AND (k % 5 = 0 OR undated OR away)
  UNION ALL SELECT k, 'V4', 'notes' FROM b WHERE st = 1 AND k % 12 = 1 UNION ALL SELECT k, 'V5', 'access' FROM b WHERE st = 2 AND NOT away UNION ALL SELECT k, 'V5', 'who, when and why' FROM b WHERE st = 2 AND (k % 5 = 0 OR undated OR k % 12 = 1)
  UNION ALL SELECT k, 'V6', 'a date' FROM b WHERE st = 3 AND NOT undated UNION ALL SELECT k, 'V7', 'unknown claim' FROM b WHERE k % 3 <> 0 AND st = 3
  UNION ALL SELECT b.k, 'V8', 'supersedes unknown' FROM b LEFT JOIN b o ON o.k = b.sup WHERE b.sup IS NOT NULL AND o.k IS NULL UNION ALL SELECT b.k, 'V8', 'supersedes another claim''s' FROM b JOIN b o ON o.k = b.sup WHERE (o.ref, o.claim) <> (b.ref, b.claim)
  UNION ALL SELECT sup, 'V8', 'superseded twice' FROM b WHERE sup IS NOT NULL GROUP BY sup HAVING count(*) > 1
)
SELECT CAST(k AS VARCHAR) AS id, rule, what FROM p
UNION ALL SELECT id, 'K6', 'verified without a record' FROM refs WHERE status = '{VERIFIED}' AND i NOT IN (SELECT ref FROM b WHERE st = 0 AND k NOT IN (SELECT sup FROM b WHERE sup IS NOT NULL))
""")
def verification_rules(spark: SparkSession, d: str) -> DataFrame:
    """Customers as verification records of claims c0 to c2 and of free texts."""
    k = F.col("c_custkey")
    undated = k % 6 == 0
    v = table(spark, d, "customer").select(
        k.cast("string").alias("verification_id"), F.concat(F.lit("r"), (k % 7).cast("string")).alias("ref_id"), F.when(k % 3 == 0, NA).otherwise(F.concat(F.lit("c"), (k % 4).cast("string"))).alias("claim_id"), F.lit("Text").alias("claim"),
        pick(k, STATUSES).alias("status"), F.when(k % 5 != 0, "v").alias("verifier"), F.lit("expert").alias("verifier_role"), F.when(undated, NA).when(k % 11 == 0, "2999-01-01").otherwise("2020-01-01").alias("verification_date"),
        F.when(k % 8 != 0, "p. 1").alias("locator"), F.when(k % 9 != 0, "shelf").alias("source_location"), F.when((k % 10 == 0) | ((k % 4 == 2) & (k % 3 != 0)), "not_accessed").otherwise("read").alias("source_access"), F.when(k % 12 != 1, "n").alias("notes"),
        F.when(k % 13 == 0, k - 1).when((k % 13 == 1) & (k > 1), k - 2).when(k % 17 == 0, -k).cast("string").alias("supersedes"),
    )
    claims = spark.createDataFrame([("c0",), ("c1",), ("c2",)], "claim_id string")
    return G.verification_problems(v, reference_table(spark), claims, F.lit("2026-01-01").cast("date"))


@query("""
WITH b AS (SELECT s_suppkey AS k, s_suppkey % 7 AS ref, s_suppkey % 5 AS src, s_suppkey % 4 AS f FROM supplier),
p AS (
  SELECT 's' || k AS id, 'PC2' AS rule, 'unknown reference' AS what FROM b WHERE ref = 6 UNION ALL SELECT 's' || k, 'PC7', 'an unresolved placeholder' FROM b WHERE ref = 5 AND f < 2
  UNION ALL SELECT 's' || k, 'PC3', 'unknown claim' FROM b WHERE k % 3 = 2 UNION ALL SELECT 's' || k, 'PC3', 'claim of another reference' FROM b WHERE k % 3 <> 2 AND ref > 2
  UNION ALL SELECT 's' || k, 'PC4', 'unknown source' FROM b WHERE src = 4 UNION ALL SELECT 's' || k, 'PC4', 'source of another reference' FROM b WHERE src < 4 AND src <> ref UNION ALL SELECT 's' || k, 'PC6', 'source without the text' FROM b WHERE f <> 3 AND src = 3
  UNION ALL SELECT 's' || k, 'PC5', 'locator and excerpt' FROM b WHERE f < 2 AND k % 6 = 0 UNION ALL SELECT 's' || k, 'PC5', 'differences' FROM b WHERE f = 1 AND k % 8 = 1 UNION ALL SELECT 's' || k, 'PC8', 'in the future' FROM b WHERE k % 9 = 0
)
SELECT id, rule, what FROM p UNION ALL SELECT 'q2', 'PC8', 'in the future'
""")
def precheck_rules(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as claim checks against four sources."""
    k = F.col("s_suppkey")
    checks = table(spark, d, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("precheck_id"), F.concat(F.lit("r"), (k % 7).cast("string")).alias("ref_id"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("claim_id"), F.concat(F.lit("q"), (k % 5).cast("string")).alias("source_id"),
        pick(k, ["found", "found_with_differences", "not_found", "source_not_accessible"]).alias("finding"), F.when(k % 6 != 0, "p. 1").alias("locator_found"), F.lit("words").alias("excerpt"), F.when(k % 8 != 1, "d").alias("differences"),
        F.when(k % 9 == 0, "2999-01-01").otherwise("2020-01-01").alias("check_date"),
    )
    sources = spark.createDataFrame([(f"q{i}", f"r{i}", "catalogue_only" if i == 3 else "full_text", "2999-01-01" if i == 2 else "2020-01-01") for i in range(4)], "source_id string, ref_id string, access string, accessed string")
    claims = spark.createDataFrame([("c0", ["r0", "r1", "r2"]), ("c1", ["r0", "r1", "r2"])], "claim_id string, ref_ids array<string>")
    return G.precheck_problems(checks, sources, reference_table(spark), claims, F.lit("2026-01-01").cast("date"), ["full_text", "preview"], ["found", "found_with_differences"])
