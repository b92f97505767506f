"""Orders as objects and their lines as evidence: type, source and bounds follow from a line's numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.operators import dating as D
from curata.queries._registry import query, table
from curata.queries.governance import pick

TYPES = [*D.STRENGTH, "other"]
PROVENANCE = ["expert_annotation", "expert_annotation", "project_annotation", "ai_prediction", "expert_annotation"]
ASSOCIATION = ["direct", "same_context_secure", "uncertain"]
CITED = ["annotator_observation", "ref-a", "ref-b", "ref-unknown"]
LEVELS = ["high", "moderate", "unknown", "low", "unknown", "very_low", "unsaid"]
SCRIPTS, SCRIPT_BY = ["s1", "s2"], ["expert_annotation", "source_information", "ai_prediction"]


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """A line of an order; equal lines are told apart by all their numbers. Dealt out by order, as plain numbers: nothing that follows shuffles them again."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").repartition("l_orderkey")
    line = line.withColumn("l_extendedprice", F.col("l_extendedprice").cast("decimal(20,2)")).distinct()
    item = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.col("l_extendedprice").cast("string"))
    p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("int")
    low = (F.lit(-300) + p * 7 % 200).cast("int")
    return line.select(
        F.col("l_orderkey").alias("object"), item.alias("item"), pick(p, TYPES).alias("evidence_type"), pick(s, PROVENANCE).alias("provenance"), pick(q, ASSOCIATION).alias("association"), pick(p + q, CITED).alias("source_reference"),
        pick(q, LEVELS).alias("confidence"), F.when(p % 5 != 0, low).alias("start"), F.when(q % 4 != 0, low + 200 + q).alias("end"))


def objects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("object"), F.when(k % 3 != 0, "excavated_stratified").otherwise("unknown").alias("context"), pick(k, SCRIPTS).alias("script"), pick(k, SCRIPT_BY).alias("script_provenance"))


def references(spark: SparkSession) -> DataFrame:
    registry = spark.createDataFrame([("ref-a", D.VERIFIED)], "ref_id string, status string")
    return D.reference_infos(registry, spark.createDataFrame([("ref-a", "unverified"), ("ref-b", D.VERIFIED)], "ref_id string, status string"))


def weighed(spark: SparkSession, d: str) -> DataFrame:
    return D.weigh(evidence(spark, d), objects(spark, d), references(spark), "object", "item")


def sql_pick(k: str, words: list[str]) -> str:
    return f"[{', '.join(repr(w) for w in words)}][CAST(({k}) % {len(words)} + 1 AS INT)]"


TIERS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.STRENGTH.items())
KINDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.CATEGORY.items())
WEIGHED = f"""
l AS (SELECT DISTINCT l_orderkey AS object, concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS VARCHAR)) AS item, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS INT) AS q FROM lineitem),
e AS (SELECT object, item, {sql_pick("p", TYPES)} AS evidence_type, {sql_pick("s", PROVENANCE)} AS provenance, {sql_pick("q", ASSOCIATION)} AS association, {sql_pick("p + q", CITED)} AS source_reference, {sql_pick("q", LEVELS)} AS confidence,
  CASE WHEN p % 5 <> 0 THEN -300 + p * 7 % 200 END AS s, CASE WHEN q % 4 <> 0 THEN -300 + p * 7 % 200 + 200 + q END AS e FROM l),
o AS (SELECT o_orderkey AS object, CASE WHEN o_orderkey % 3 <> 0 THEN 'excavated_stratified' ELSE 'unknown' END AS context, {sql_pick("o_orderkey", SCRIPTS)} AS script, {sql_pick("o_orderkey", SCRIPT_BY)} AS script_provenance FROM orders),
x AS (SELECT e.*, CASE source_reference WHEN 'ref-a' THEN '{D.VERIFIED}' WHEN 'ref-b' THEN 'unverified' END AS ref_status, CASE evidence_type {TIERS} ELSE 9 END AS tier, CASE evidence_type {KINDS} ELSE 'uncertainty' END AS category,
  CASE WHEN provenance = 'ai_prediction' THEN 'prediction' WHEN e.s IS NULL AND e.e IS NULL THEN 'no bounds' WHEN evidence_type IN ('stratigraphy', 'absolute_dating') AND association = 'uncertain' THEN 'association not secure'
    WHEN evidence_type = 'stratigraphy' AND context IS DISTINCT FROM 'excavated_stratified' THEN 'context not stratified' WHEN source_reference = 'ref-unknown' THEN 'unknown reference' END AS excluded
  FROM e LEFT JOIN o USING (object)),
k AS (SELECT object, item, s, e, row_number() OVER (PARTITION BY object ORDER BY tier, item) AS k FROM x WHERE excluded IS NULL),
f(object, item, k, lo, hi, used) AS (
  SELECT object, item, k, s, e, s IS NULL OR e IS NULL OR s <= e FROM k WHERE k = 1
  UNION ALL
  SELECT k.object, k.item, k.k, CASE WHEN coalesce(greatest(f.lo, k.s) <= least(f.hi, k.e), true) THEN greatest(f.lo, k.s) ELSE f.lo END, CASE WHEN coalesce(greatest(f.lo, k.s) <= least(f.hi, k.e), true) THEN least(f.hi, k.e) ELSE f.hi END,
    coalesce(greatest(f.lo, k.s) <= least(f.hi, k.e), true) FROM f JOIN k ON k.object = f.object AND k.k = f.k + 1
),
w AS (SELECT x.*, f.used FROM x LEFT JOIN f USING (object, item))
"""


@query(f"WITH RECURSIVE {WEIGHED} SELECT object, item, tier, category, excluded, used FROM w")
def dating_evidence(spark: SparkSession, d: str) -> DataFrame:
    return weighed(spark, d).select("object", "item", "tier", "category", "excluded", "used")


DATES = """
g AS (SELECT object, max(s) FILTER (WHERE used) AS lo, min(e) FILTER (WHERE used) AS hi, count(*) FILTER (WHERE used) AS n_used, count(*) FILTER (WHERE NOT used) AS n_conflicts, count(*) FILTER (WHERE excluded IS NOT NULL) AS n_excluded,
  count(DISTINCT evidence_type) FILTER (WHERE used) AS n_types, min(tier) FILTER (WHERE used) AS tier, bool_and(provenance = 'expert_annotation') FILTER (WHERE used) AS expert,
  bool_and(source_reference IN ('annotator_observation', 'ref-a')) FILTER (WHERE used) AS ver, max(list_position(['unknown', 'very_low', 'low', 'moderate', 'high'], confidence)) FILTER (WHERE used) AS best FROM w GROUP BY object),
j AS (SELECT o.*, lo, hi, coalesce(n_used, 0) AS n_used, coalesce(n_conflicts, 0) AS n_conflicts, coalesce(n_excluded, 0) AS n_excluded, n_types, tier, expert, ver, best FROM o LEFT JOIN g USING (object)),
t AS (SELECT object, CASE WHEN n_used > 0 THEN 'estimated' WHEN script = 's1' AND script_provenance <> 'ai_prediction' THEN 'outer_bound_only' ELSE 'insufficient_evidence' END AS state, lo, hi, n_used, n_conflicts, n_excluded,
  ['unknown', 'very_low', 'low', 'moderate', 'high'][least(CASE WHEN NOT (expert AND n_types > 1 AND tier <= 2 AND n_conflicts = 0 AND ver) THEN 3 WHEN tier = 1 AND context = 'excavated_stratified' THEN 5 ELSE 4 END, coalesce(best, 3))] AS level FROM j),
dates AS (SELECT object, state, CAST(CASE state WHEN 'estimated' THEN lo WHEN 'outer_bound_only' THEN -250 END AS INT) AS start, CAST(CASE state WHEN 'estimated' THEN hi END AS INT) AS "end",
  CASE state WHEN 'estimated' THEN level WHEN 'outer_bound_only' THEN 'very_low' ELSE 'unknown' END AS confidence, n_used, n_conflicts, n_excluded FROM t)
"""


@query(f"WITH RECURSIVE {WEIGHED}, {DATES} SELECT * FROM dates")
def dating_estimate(spark: SparkSession, d: str) -> DataFrame:
    return D.estimate_dates(weighed(spark, d), objects(spark, d), "object", "s1", -250).drop("display", "centuries")


@query(f"""
WITH RECURSIVE {WEIGHED}, y AS (SELECT object, category, coalesce(used, false) AS used FROM w UNION ALL SELECT object, 'publication_attribution', coalesce(used, false) FROM w WHERE source_reference LIKE 'ref-%' AND category <> 'publication_attribution')
SELECT object, category, count(*) AS n, count(*) FILTER (WHERE used) AS n_used FROM y GROUP BY object, category
""")
def dating_categories(spark: SparkSession, d: str) -> DataFrame:
    return D.by_category(weighed(spark, d), "object")


def stated(spark: SparkSession, d: str) -> DataFrame:
    """Events as raters' positions on the date of a user's object."""
    k = F.col("event_id")
    rows = table(spark, d, "events").select("user_id", k, pick(k, ["expert_annotation", "project_annotation", "ai_prediction"]).alias("kind"), F.when(k % 4 == 0, -100).when(k % 4 == 1, F.col("user_id").cast("int")).alias("start"), F.when(k % 8 == 0, 50).alias("end"), (k % 3).alias("n_evidence"))
    return D.positions(rows, "user_id", "kind", "start", "end", "n_evidence")


@query("""
WITH p AS (SELECT user_id, CASE WHEN event_id % 4 = 0 THEN -100 WHEN event_id % 4 = 1 THEN user_id END AS s, CASE WHEN event_id % 8 = 0 THEN 50 END AS e FROM events WHERE event_id % 3 <> 2 AND (event_id % 4 < 2 OR event_id % 3 > 0))
SELECT user_id, count(DISTINCT (s, e)) FILTER (WHERE s IS NOT NULL OR e IS NOT NULL) AS n_ranges, count(DISTINCT (s, e)) FILTER (WHERE s IS NOT NULL OR e IS NOT NULL) > 1 AS conflict FROM p GROUP BY user_id
""")
def dating_positions(spark: SparkSession, d: str) -> DataFrame:
    return D.position_conflicts(stated(spark, d), "user_id", "start", "end")


@query(f"""
WITH RECURSIVE {WEIGHED}, {DATES},
r AS (SELECT *, CASE object % 5 WHEN 0 THEN 'disputed' WHEN 1 THEN 'project_disagreement' WHEN 2 THEN 'expert_label' END AS status, object % 7 = 0 AS apart, object % 2 = 0 AS sk, object % 3 = 0 AS rk, ['complete', 'partial', 'fragmentary', 'illegible'][object % 4 + 1] AS comp, object % 6 AS alt,
  object % 2 <> 0 AND object % 3 <> 0 AND state = 'insufficient_evidence' AS nothing FROM dates)
SELECT object, CASE WHEN (apart OR coalesce(status IN ('disputed', 'project_disagreement'), false)) AND confidence IN ('moderate', 'high') THEN 'low' ELSE confidence END AS confidence,
  concat_ws('; ', CASE WHEN status = 'disputed' THEN 'disputed' END, CASE WHEN status = 'project_disagreement' THEN 'raters disagree' END, CASE WHEN nothing THEN 'insufficient evidence' END, CASE WHEN NOT rk AND comp = 'illegible' THEN 'illegible' END,
    CASE WHEN rk AND comp IN ('partial', 'fragmentary') THEN comp END, CASE WHEN rk AND alt > 0 THEN 'alternative readings' END, CASE WHEN apart THEN 'conflicting dates' END, CASE WHEN state = 'insufficient_evidence' AND NOT nothing THEN 'dating: insufficient evidence' END) AS statements FROM r
""")
def object_statements(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("object")
    o = objects(spark, d)
    dates = D.estimate_dates(weighed(spark, d), o, "object", "s1", -250)
    status = o.where("object % 5 < 3").select("object", pick(k % 5, ["disputed", "project_disagreement", "expert_label"]).alias("status"))
    readings = o.select("object", (k % 2 == 0).alias("script_known"), (k % 3 == 0).alias("reading_known"), pick(k, ["complete", "partial", "fragmentary", "illegible"]).alias("completeness"), (k % 6).alias("n_alternatives"))
    return D.statements(dates, status, o.select("object", (k % 7 == 0).alias("conflict")), readings, "object")
