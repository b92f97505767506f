"""Customers as items: their orders are both the experts' rows about them and their records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.operators import promotion as P
from curata.queries._registry import query, table
from curata.queries.dating import sql_pick
from curata.queries.governance import pick

STATUSES = ["expert_label", "adjudicated", "disputed", "expert_label", "provisional"]
ORIGINS = ["original", "original", "uncertain", "original", "original", "reproduction", "original"]
SURE = ["high", "moderate", "unknown", "low"]


def status(spark: SparkSession, d: str) -> DataFrame:
    """An item is a customer."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("item"), pick(k, STATUSES).alias("status"), F.when(k % 11 != 0, F.when(k % 13 == 0, "other_script").otherwise(F.col("c_mktsegment"))).alias("label"), (k % 11 != 0).alias("ground_truth"))


def experts(spark: SparkSession, d: str) -> DataFrame:
    """An expert's row is a customer's order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        c.alias("item"), F.when(k % 41 == 0, " ").otherwise("PhD").alias("qualification"), F.when((c % 3 == 0) & (k % 5 == 0), "no").otherwise("yes").alias("present"), F.when(c % 4 == 0, pick(k, ORIGINS)).otherwise("original").alias("object_status"),
        F.when(c % 2 == 0, "a  b").otherwise(F.concat(F.lit("r"), (k % 2).cast("string"))).alias("reading"), F.when(k % 7 != 0, F.lit("x")).alias("note"), F.when(c % 5 != 0, -100).otherwise((k % 3).cast("int") + 1).alias("lo"), F.lit(50).alias("hi"), pick(k, SURE).alias("sure"))


def flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_custkey % 6 = 0").select(F.col("c_custkey").alias("item"))


ITEMS = f"""
s AS (SELECT c_custkey AS item, {sql_pick("c_custkey", STATUSES)} AS status, CASE WHEN c_custkey % 11 <> 0 THEN CASE WHEN c_custkey % 13 = 0 THEN 'other_script' ELSE c_mktsegment END END AS label, c_custkey % 11 <> 0 AS gt FROM customer),
x AS (SELECT o_custkey AS item, o_orderkey AS k, o_orderkey % 41 = 0 AS unq, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 'no' ELSE 'yes' END AS present, CASE WHEN o_custkey % 4 = 0 THEN {sql_pick("o_orderkey", ORIGINS)} ELSE 'original' END AS os,
  CASE WHEN o_custkey % 2 = 0 THEN 'a b' ELSE 'r' || o_orderkey % 2 END AS reading, CASE WHEN o_orderkey % 7 <> 0 THEN 'x' END AS note, CASE WHEN o_custkey % 5 <> 0 THEN -100 ELSE o_orderkey % 3 + 1 END AS lo, {sql_pick("o_orderkey", SURE)} AS sure FROM orders),
g AS (SELECT item, count(*) AS n, bool_or(unq) AS unq, count(DISTINCT present) AS np, bool_or(os = 'reproduction') AS rep, bool_or(os = 'uncertain') AS unc, bool_and(os = 'original') AS orig FROM x GROUP BY item),
e AS (SELECT s.item, s.label, CASE WHEN NOT (status IN ('expert_label', 'adjudicated') AND gt AND label IS NOT NULL) THEN 'P1 status ' || status ELSE concat_ws('; ', CASE WHEN n IS NULL THEN 'P2 no reviewed expert row' END, CASE WHEN unq THEN 'P2 no qualification' END,
  CASE WHEN np > 1 THEN 'P3 presence disputed' END, CASE WHEN label = 'other_script' THEN 'P4 label needs detail' END, CASE WHEN rep THEN 'P10 reproduction' END, CASE WHEN NOT rep AND unc THEN 'P10 status uncertain' END,
  CASE WHEN s.item % 6 = 0 AND NOT coalesce(orig, false) THEN 'P10 flagged, not stated original' END) END AS reasons FROM s LEFT JOIN g USING (item)),
a AS (SELECT item, CASE WHEN count(DISTINCT reading) > 1 THEN 'disputed' ELSE min(reading) END AS reading, CASE WHEN count(note) = count(*) THEN min(note) END AS note, CASE WHEN count(DISTINCT lo) = 1 THEN min(lo) END AS lo, CASE WHEN count(DISTINCT lo) = 1 THEN 50 END AS hi,
  ['unknown', 'very_low', 'low', 'moderate', 'high'][min(list_position(['unknown', 'very_low', 'low', 'moderate', 'high'], sure))] AS sure FROM x GROUP BY item)
"""


@query(f"WITH {ITEMS} SELECT item, label, reasons FROM e")
def promotion_eligible(spark: SparkSession, d: str) -> DataFrame:
    return P.eligible(status(spark, d), experts(spark, d), "item", flags(spark, d)).withColumn("reasons", F.array_join("reasons", "; "))


@query(f"WITH {ITEMS} SELECT item, reading, note, CAST(lo AS INT) AS lo, hi, sure FROM a")
def promotion_agreed(spark: SparkSession, d: str) -> DataFrame:
    return P.agreed(experts(spark, d), "item", ["reading", "note"], [("lo", "hi")], "sure")


def records(spark: SparkSession, d: str) -> DataFrame:
    """An order is a record of its customer; sixteen orders in seventeen have no label yet."""
    k = F.col("o_orderkey")
    mine = k % 17 == 0
    return table(spark, d, "orders").where("o_custkey % 14 <> 5").select(
        k.alias("record"), F.col("o_custkey").alias("item"), F.when(mine & (k % 5 == 0), F.lit(None)).when(mine, "BUILDING").otherwise("unknown").alias("label"), F.when(mine & (k % 2 == 0), "museum").when(mine, "expert_annotation").alias("source"), F.lit("none").alias("reading"),
        F.when(k % 19 == 0, "y").otherwise("x").alias("note"), F.col("o_totalprice").alias("price"))


PLAN = f"""
{ITEMS},
rd AS (SELECT item, label FROM e WHERE reasons = ''),
rec AS (SELECT o_orderkey AS record, o_custkey AS item, CASE WHEN o_orderkey % 85 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'BUILDING' ELSE 'unknown' END AS label, CASE WHEN o_orderkey % 34 = 0 THEN 'museum' WHEN o_orderkey % 17 = 0 THEN 'expert_annotation' END AS source,
  CASE WHEN o_orderkey % 19 = 0 THEN 'y' ELSE 'x' END AS note, o_totalprice AS price FROM orders WHERE o_custkey % 14 <> 5),
j AS (SELECT rec.*, rd.label AS nl, a.reading AS nr, a.note AS nn, rec.label IS DISTINCT FROM 'unknown' AND rec.source IS DISTINCT FROM 'expert_annotation' AS taken, a.note IS NOT NULL AND a.note <> rec.note AS illegal FROM rec JOIN rd USING (item) LEFT JOIN a USING (item)),
no AS (SELECT DISTINCT item, CASE WHEN taken THEN 'P6 labelled by another source' ELSE 'P8 protected field' END AS reason FROM j WHERE taken OR illegal UNION ALL SELECT item, 'P5 no records' FROM rd WHERE item NOT IN (SELECT item FROM rec)),
ch AS (SELECT record, item, field, before, after FROM (
  SELECT record, item, 'label' AS field, label AS before, nl AS after FROM j UNION ALL SELECT record, item, 'source', source, 'expert_annotation' FROM j UNION ALL SELECT record, item, 'reading', 'none', nr FROM j
) WHERE after IS NOT NULL AND before IS DISTINCT FROM after AND item NOT IN (SELECT item FROM no))
"""


def plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ready = P.eligible(status(spark, d), experts(spark, d), "item", flags(spark, d)).where(F.size("reasons") == 0)
    return P.plan_changes(records(spark, d), ready, P.agreed(experts(spark, d), "item", ["reading", "note"]), "item", "record", ["reading", "note"], ["label", "source", "reading"], "label", "source")


@query(f"WITH {PLAN} SELECT item, reason FROM no")
def promotion_refusals(spark: SparkSession, d: str) -> DataFrame:
    return plan(spark, d)[1]


def odd_records(after: DataFrame) -> DataFrame:
    """A disputed reading on a dear record."""
    return after.where("reading = 'disputed' AND price > 200000").select("record", F.lit("R1").alias("rule"))


@query(f"WITH {PLAN}, bad AS (SELECT DISTINCT item FROM ch JOIN rec USING (record, item) WHERE (field = 'reading' AND after = 'disputed') AND price > 200000) SELECT record, item, field, before, after FROM ch WHERE item NOT IN (SELECT item FROM bad)")
def promotion_settled(spark: SparkSession, d: str) -> DataFrame:
    return P.settle(records(spark, d), plan(spark, d)[0], odd_records, "item", "record", ["label", "source", "reading"])[0]
