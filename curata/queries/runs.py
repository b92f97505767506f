"""Events as logs of runs: what became of each item, which checkpoint and calibration a run had, and the first few of each kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions.engines import TEXTUAL, Engine, Registry, grid, robustness
from curata.operators import acquisition as A
from curata.operators.ordering import first_n, latest_before, running_sums
from curata.queries._registry import query, table

SAID = {"signup": "planned", "view": "fetched", "click": "checked", "error": "failed", "purchase": "planned"}
STEPS = " ".join(f"WHEN f.state = '{s}' AND n.e = '{e}' THEN '{to}'" for (s, e), to in A.STEPS.items())
KNOWN = " ".join(f"WHEN f.state = '{s}' AND n.e = '{e}' THEN 0" for s, e in A.STEPS)
SAYS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SAID.items())


@query(f"""
WITH RECURSIVE n AS (SELECT user_id AS batch, event_id % 3 AS item, CASE event_type {SAYS} END AS e, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id, event_id % 3) AS n FROM events),
f(batch, item, k, state, ignored) AS (
  SELECT batch, item, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT) FROM n WHERE k = 1
  UNION ALL SELECT n.batch, n.item, n.k, CASE {STEPS} ELSE f.state END, f.ignored + CASE {KNOWN} ELSE 1 END FROM f JOIN n ON n.batch = f.batch AND n.item = f.item AND n.k = f.k + 1
),
o AS (SELECT f.batch, f.item, n.n, f.state, f.ignored FROM f JOIN n ON n.batch = f.batch AND n.item = f.item AND n.k = f.k WHERE f.k = n.n)
SELECT batch, item, state, n AS n_events, ignored AS n_ignored, CASE WHEN state = 'acquired' AND bool_or(state IN ('failed', 'refused')) OVER (PARTITION BY batch) THEN 'rolled_back' ELSE state END AS outcome FROM o
""")
def acquisition_runs(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as a batch of three items; a failed or refused member takes back what the others acquired."""
    says = F.create_map(*[F.lit(x) for kv in SAID.items() for x in kv])
    log = table(spark, d, "events").select(F.col("user_id").alias("batch"), (F.col("event_id") % 3).alias("item"), "event_id", F.try_element_at(says, F.col("event_type")).alias("event"))
    return A.outcomes(A.fold_states(log, ["batch", "item"], "event_id", "event"), ["batch"], ("failed", "refused"))


@query("""
WITH c AS (SELECT user_id % 5 AS print, event_id AS at, event_id AS checkpoint_id, value AS checkpoint_loss FROM events WHERE event_type = 'view'), k AS (SELECT user_id % 5 AS print, event_id AS at, event_id AS calibration_id FROM events WHERE event_type = 'click'),
r AS (SELECT event_id AS run_id, user_id % 5 AS print, event_id AS at FROM events WHERE event_type = 'purchase')
SELECT r.run_id, r.print, c.checkpoint_id, c.checkpoint_loss, k.calibration_id, coalesce(k.at >= c.at, false) AS calibrated
FROM r ASOF LEFT JOIN c ON r.print = c.print AND r.at >= c.at ASOF LEFT JOIN k ON r.print = k.print AND r.at >= k.at
""")
def reproducibility_report(spark: SparkSession, d: str) -> DataFrame:
    """Each run with the newest checkpoint and calibration of its own fingerprint (five in all) that are not later than it, and whether the calibration is of that checkpoint."""
    e, k = table(spark, d, "events"), F.col("event_id")
    of = lambda kind, *cols: e.where(F.col("event_type") == kind).select((F.col("user_id") % 5).alias("print"), k.alias("at"), *cols)
    runs = of("purchase", k.alias("run_id"))
    j = latest_before(runs, of("view", k.alias("checkpoint_id"), F.col("value").alias("checkpoint_loss")), "print", "at", ["checkpoint_id", "checkpoint_loss"])
    j = latest_before(j, of("click", k.alias("calibration_id")), "print", "at", ["calibration_id"])
    return j.select("run_id", "print", "checkpoint_id", "checkpoint_loss", "calibration_id", F.coalesce(F.col("calibration_id") >= F.col("checkpoint_id"), F.lit(False)).alias("calibrated"))


@query("""
WITH f AS (SELECT o_orderstatus || ':' || o_orderpriority AS rule, o_orderkey AS record_index FROM orders)
SELECT rule, record_index, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY rule ORDER BY record_index) AS INT) AS place FROM f) WHERE place <= 5
""")
def first_findings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as findings: the first five records of each rule."""
    found = table(spark, d, "orders").select(F.concat_ws(":", "o_orderstatus", "o_orderpriority").alias("rule"), F.col("o_orderkey").alias("record_index"))
    return first_n(found, 5, ["record_index"], ["rule"])


@query("""
SELECT event_id, event_type, value, CAST(row_number() OVER (ORDER BY value DESC, event_id) AS INT) AS place FROM events WHERE event_type = 'error' QUALIFY place <= 100
""")
def surest_errors(spark: SparkSession, d: str) -> DataFrame:
    """The hundred errors of the highest value, ties by id."""
    return first_n(table(spark, d, "events").where("event_type = 'error'").select("event_id", "event_type", "value"), 100, [F.desc("value")])


@query("""
WITH q AS (SELECT c_custkey, c_custkey % 7 = 0 AS pilot, c_nationkey FROM customer) SELECT c_custkey, pilot, row_number() OVER (ORDER BY pilot DESC, c_custkey) AS place FROM q
""")
def queue_places(spark: SparkSession, d: str) -> DataFrame:
    """The place of each item in a queue: the pilot's first, then by id."""
    queue = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 7 == 0).alias("pilot")).withColumn("late", ~F.col("pilot"))
    return running_sums(queue, ["late", "c_custkey"], {"place": None}).drop("late")


def lengths() -> Engine:
    """A classifier by length: long texts have over 500 characters."""
    return Engine("lengths", "classifier", "1", lambda: lambda texts: [(None, None) if t is None else ("long" if len(t) > 500 else "short", 1.0) for t in texts])


@query("""
WITH t AS (SELECT 'clean' AS perturbation, 'none' AS family, 'none' AS severity, text, text AS x FROM documents UNION ALL SELECT 'no_vowels', 'loss', 'moderate', text, regexp_replace(text, '[aeiouAEIOU]', '', 'g') FROM documents
  UNION ALL SELECT 'first_half', 'crop', 'strong', text, substr(text, 1, length(text) // 2) FROM documents),
g AS (SELECT perturbation, family, severity, count(*) AS n, count(*) FILTER (WHERE (length(x) > 500) = (length(text) > 500)) AS n_right FROM t GROUP BY ALL)
SELECT *, round(n_right / n, 9) AS accuracy, round(max(n_right / n) FILTER (WHERE perturbation = 'clean') OVER () - n_right / n, 9) AS drop_from_clean FROM g
""")
def perturbation_grid(spark: SparkSession, d: str) -> DataFrame:
    """How a classifier by length stands up to texts without vowels and to first halves."""
    engines = Registry()
    engines.add(lengths())
    docs = table(spark, d, "documents").select("doc_id", "text", F.when(F.length("text") > 500, "long").when(F.col("text").isNotNull(), "short").alias("truth"))
    said = engines.apply(grid(docs, "doc_id", "text", TEXTUAL[:3]), "classifier", "text")
    out = robustness(said.withColumn("right", F.col("label") == F.col("truth")), "right")
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "drop_from_clean")})
