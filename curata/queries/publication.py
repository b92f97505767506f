"""Published tables: orders promoted by an approved plan and taken back, events let in by batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.operators import publication as P
from curata.operators.governance import repeated
from curata.plans.storage import shared_dir
from curata.plans.versions import Published
from curata.queries._registry import query, table

RECORD = ["o_orderstatus", "o_clerk_note"]


def plan_of(records: DataFrame) -> DataFrame:
    """Every seventh order becomes 'P', every ninth loses its note; what is so already is no change."""
    k = F.col("o_orderkey")
    asked = F.array(
        F.when(k % 7 == 0, F.struct(F.lit("o_orderstatus").alias("field"), F.col("o_orderstatus").alias("before"), F.lit("P").alias("after"))),
        F.when(k % 9 == 0, F.struct(F.lit("o_clerk_note").alias("field"), F.col("o_clerk_note").alias("before"), F.lit(None).cast("string").alias("after"))),
    )
    return records.select("o_orderkey", F.explode(F.array_compact(asked)).alias("x")).select("o_orderkey", "x.*").where("NOT (before <=> after)")


@query("""
WITH r AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS o_clerk_note FROM orders)
SELECT 0 AS version, o_orderkey, o_orderstatus, o_clerk_note FROM r UNION ALL SELECT 2, * FROM r
UNION ALL SELECT 1, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'P' ELSE o_orderstatus END, CASE WHEN o_orderkey % 9 <> 0 THEN o_clerk_note END FROM r
""")
def published_promotion(spark: SparkSession, d: str) -> DataFrame:
    """The three versions: as first published, promoted, taken back."""
    orders = Published(spark, shared_dir(spark, "orders"))
    orders.publish(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("o_clerk_note")), -1)
    done = P.promote(orders, plan_of, "o_orderkey", RECORD, "reviewer", P.dry_run(orders, plan_of, "o_orderkey"))
    back = P.plan_digest(P.revert_plan(orders, done["version"], "o_orderkey"), "o_orderkey").first().digest
    P.revert(orders, done["version"], "o_orderkey", RECORD, "reviewer", back)
    versions = [orders.read(v).select(F.lit(v).alias("version"), "o_orderkey", *RECORD) for v in range(3)]
    return versions[0].unionByName(versions[1]).unionByName(versions[2])


def rules(rows: DataFrame) -> DataFrame:
    """severity, id: a repeated id is an error, a value that is not positive another."""
    twice = repeated(rows, "item", "R1").select(F.lit("error").alias("severity"), F.col("id").cast("string").alias("id"))
    return twice.unionByName(rows.where(F.coalesce(F.col("value") <= 0, F.lit(True))).select(F.lit("error").alias("severity"), F.col("item").cast("string").alias("id")))


@query("""
SELECT event_id % 5 AS batch, event_type, count(*) AS n FROM events WHERE event_id % 5 IN (0, 2, 4) GROUP BY ALL
""")
def ingested_batches(spark: SparkSession, d: str) -> DataFrame:
    """Five batches by number: the second holds values that are not positive, and the fourth ids of the first, so neither gets in."""
    events = Published(spark, shared_dir(spark, "events"))
    k = F.col("event_id")
    rows = table(spark, d, "events").select(k, (k % 5).alias("batch"), "event_type", "value")
    for b in range(5):
        value = F.when(k % 5 == 1, -F.abs("value") - 1).otherwise(F.abs("value") + 1)
        one = rows.where(F.col("batch") == b).select(F.when(k % 5 == 3, k - 3).otherwise(k).alias("item"), "batch", "event_type", value.alias("value"))
        P.ingest(events, one, rules, {"batch": b}, note=True)
    return events.read().groupBy("batch", "event_type").agg(F.count(F.lit(1)).alias("n"))
