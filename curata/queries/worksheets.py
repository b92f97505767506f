"""Parts as rows of a filled worksheet, two rows an artifact, and suppliers as rows of a checklist; what is wrong follows from their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.queries._registry import query, table
from curata.sources import worksheet as W

STATUSES = ("verified_against_source", "discrepancy_found", "unverified")


def sheet(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    cell = lambda *cases: F.coalesce(*[F.when(c, F.lit(v) if isinstance(v, str) else v) for c, v in cases], F.lit(""))
    other: Column = ~(k % 10 == 9)  # every tenth row says nothing
    return table(spark, d, "part").select(
        k.alias("row"), F.concat(F.lit("art-"), (k - k % 2).cast("string")).alias("artifact_id"), F.concat(F.lit("img-"), k.cast("string")).alias("image_id (of the row)"), cell((other & (k % 31 != 3), "ann")).alias("annotator_id (yours)"),
        cell((other & (k % 14 == 3), "none"), (other, "brahmi")).alias("script_type (one of)"), cell((other & (k % 7 == 4), "many"), (other & (k % 3 == 0), "4")).alias("characters_visible"),
        cell((other & (k % 5 == 0), F.concat(F.lit("0.1,0.2,0.3,"), (k % 9 / 10).cast("string"), F.lit(" character #2 'ka'; 0,0,1,1 text"))), (other & (k % 5 == 1), "somewhere on top")).alias("regions"),
        cell((other & (k % 11 == 0), "-300..-100"), (other & (k % 11 == 1), "100 to 200"), (other & (k % 11 == 2), "Insufficient evidence"), (other & (k % 11 == 3), "3rd century")).alias("dating_range"),
        cell((other & (k % 6 == 1), "palaeography; form of the sign; -200..100; r1 | stratigraphy; layer 4; -; "), (other & (k % 24 == 2), "palaeography; form"), (other & (k % 24 == 4), "dreams; seen; -; r1")).alias("dating_evidence"),
        cell((other & (k % 3 == 1), "context only"), (other, "object")).alias("dating_object_or_context"), cell((other & (k % 8 == 1), "r1 p. 5; r2"), (other & (k % 8 == 5), "r1, r9 fig. 2")).alias("references"),
    )


def imported(spark: SparkSession, d: str) -> W.Import:
    known = spark.createDataFrame([("r1", "bibliographic_only"), ("r2", "unverified")], "ref_id string, status string")
    current = table(spark, d, "part").where("p_partkey % 52 = 0").select(F.concat(F.lit("art-"), F.col("p_partkey").cast("string")).alias("artifact_id"), F.lit("ann").alias("annotator_id"), F.concat(F.lit("old-"), F.col("p_partkey").cast("string")).alias("annotation_id"))
    return W.import_worksheet(sheet(spark, d), known, current)


SHEET = """
k AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 10 <> 9), named AS (SELECT k, k - k % 2 AS art FROM k WHERE k % 31 <> 3),
g AS (SELECT art, min(k) AS row, count(DISTINCT CASE WHEN k % 14 = 3 THEN 'none' ELSE 'brahmi' END) AS scripts, min(CASE WHEN k % 14 = 3 THEN 'none' ELSE 'brahmi' END) AS script FROM named GROUP BY art)
"""


@query(f"""
WITH {SHEET}
SELECT k AS row, 'annotator_id' AS "column", 'answers without an annotator' AS problem FROM k WHERE k % 31 = 3
UNION ALL SELECT k, 'characters_visible', 'no count: many' FROM k WHERE k % 7 = 4
UNION ALL SELECT k, 'dating_range', 'not start..end in signed years: 3rd century' FROM k WHERE k % 11 = 3
UNION ALL SELECT k, 'dating_evidence', 'item 1: not ''type; observation; start..end or -; source''' FROM k WHERE k % 24 = 2
UNION ALL SELECT k, 'dating_evidence', 'item 1: unknown evidence type dreams' FROM k WHERE k % 24 = 4
UNION ALL SELECT k, 'references', 'unknown reference r9' FROM k WHERE k % 8 = 5
UNION ALL SELECT row, 'script_type', 'differs between rows of one artifact' FROM g WHERE scripts > 1
UNION ALL SELECT row, 'annotator_id', 'has annotated this already: old-' || art FROM g WHERE art % 52 = 0
""")
def worksheet_problems(spark: SparkSession, d: str) -> DataFrame:
    return imported(spark, d).problems


@query(f"""
WITH {SHEET},
y AS (SELECT art, max_by(CASE k % 11 WHEN 0 THEN -300 ELSE 100 END, k) AS s, max_by(CASE k % 11 WHEN 0 THEN -100 ELSE 200 END, k) AS e FROM named WHERE k % 11 < 2 GROUP BY art),
r AS (SELECT art, sum(CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END) AS n, max(CASE WHEN k % 5 = 0 THEN k % 9 / 10 END) AS h FROM named GROUP BY art),
v AS (SELECT art, 2 AS n, max(CASE WHEN k % 3 = 1 THEN 'same_context_insecure' ELSE 'direct' END) AS assoc FROM named WHERE k % 6 = 1 GROUP BY art),
c AS (SELECT art, string_agg(DISTINCT x, ',' ORDER BY x) AS refs FROM (SELECT art, unnest(CASE k % 8 WHEN 1 THEN ['r1 p. 5 bibliographic_only', 'r2 - unverified'] WHEN 5 THEN ['r1 - bibliographic_only'] END) AS x FROM named) GROUP BY art)
SELECT 'art-' || g.art AS artifact_id, CASE WHEN g.art % 52 = 0 THEN 'old-' || g.art END AS supersedes, script AS script_type, CAST(y.s AS INT) AS start, CAST(y.e AS INT) AS "end", (SELECT count(*) FROM named WHERE named.art = g.art) AS n_images,
  r.n AS n_regions, r.h AS highest, v.n AS n_evidence, v.assoc AS association, c.refs AS refs
FROM g LEFT JOIN y USING (art) LEFT JOIN r USING (art) LEFT JOIN v USING (art) LEFT JOIN c USING (art)
""")
def worksheet_rows(spark: SparkSession, d: str) -> DataFrame:
    """What the sheet would write, by its artifact."""
    said = F.transform("references", lambda x: F.concat_ws(" ", x["ref_id"], F.coalesce(x["locator"], F.lit("-")), x["status"]))
    return imported(spark, d).rows.select(
        "artifact_id", "supersedes", "script_type", "start", "end", F.size("image_ids").cast("long").alias("n_images"), F.size("regions").cast("long").alias("n_regions"), F.array_max(F.transform(F.filter("regions", lambda x: x["label"] == "character"), lambda x: x["height"])).alias("highest"),
        F.when(F.col("evidence").isNotNull(), F.size("evidence")).alias("n_evidence"), F.element_at(F.filter(F.transform("evidence", lambda x: x["association"]), lambda a: a.isNotNull()), 1).alias("association"), F.array_join(said, ",").alias("refs"))


@query("""
WITH s AS (SELECT s_suppkey AS row, CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE 'r' || s_suppkey % 40 END AS ref_id, 'c' || s_suppkey AS claim_id, CASE s_suppkey % 4 WHEN 0 THEN 'verified_against_source' WHEN 1 THEN 'discrepancy_found' WHEN 2 THEN '' ELSE 'perhaps' END AS status FROM supplier)
SELECT row, ref_id, claim_id, status, CASE WHEN row % 3 = 0 THEN 'not_available' ELSE 'p. ' || row END AS locator_found, CASE WHEN row % 5 = 0 AND ref_id <> '' THEN 'v' || row END AS supersedes, (status = 'perhaps')::INT + (ref_id = '')::INT AS n_problems FROM s WHERE status <> ''
""")
def checklist_import(spark: SparkSession, d: str) -> DataFrame:
    """Checked claims with the records that they replace and the number of their problems."""
    k, ref = F.col("s_suppkey"), F.when(F.col("s_suppkey") % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("r"), (F.col("s_suppkey") % 40).cast("string")))
    status = F.when(k % 4 == 0, STATUSES[0]).when(k % 4 == 1, STATUSES[1]).when(k % 4 == 2, "").otherwise("perhaps")
    suppliers = table(spark, d, "supplier")
    cells = suppliers.select(k.alias("row"), ref.alias("ref_id"), F.concat(F.lit("c"), k.cast("string")).alias("claim_id"), status.alias("status (one of)"), F.when(k % 3 != 0, F.concat(F.lit("p. "), k.cast("string"))).alias("locator_found (page)"))
    current = suppliers.where("s_suppkey % 5 = 0").select(F.nullif(ref, F.lit("")).alias("ref_id"), F.concat(F.lit("c"), k.cast("string")).alias("claim_id"), F.concat(F.lit("v"), k.cast("string")).alias("verification_id"))
    done = W.import_checklist(cells, current, STATUSES, {"locator_found": "not_available"})
    wrong = done.problems.groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("n_problems"))
    return done.rows.join(wrong, "row", "left").select("row", "ref_id", "claim_id", "status", "locator_found", "supersedes", F.coalesce("n_problems", F.lit(0)).alias("n_problems"))
