"""Parts as names of artifacts from which records are generated; the SQL draws the same numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.operators import generated as G
from curata.queries._registry import query, table

CONFIG = G.Config(seed=7, classes=("brahmi", "graffiti", "none", "uncertain"))


def drawn(*place: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', '{CONFIG.seed}', a, {', '.join(place)})), 1, 8) AS BIGINT)"


RECORDS = f"""
a AS (SELECT CAST(p_partkey AS VARCHAR) AS a, p_partkey AS k FROM part),
b AS (SELECT a, k, ['brahmi', 'graffiti', 'none', 'uncertain'][{drawn("'class'")} % 4 + 1] AS label, {drawn("'views'")} % 4 + 1 AS n, {drawn("'length'")} % 8 + 1 AS m FROM a),
g AS (SELECT *, array_to_string([('G' || lpad(CAST({drawn("'glyph'", "i")} % 24 AS VARCHAR), 2, '0')) FOR i IN range(1, m + 1)], ' ') AS glyphs FROM b),
v AS (SELECT *, unnest(range(1, n + 1)) AS view FROM g),
w AS (SELECT a, k, label, glyphs, view, 'SYN-' || a || '-V' || view AS record, {drawn("'view'", "view", "'width'")} % 200 + 300 AS width, {drawn("'view'", "view", "'height'")} % 150 + 200 AS height, {drawn("'view'", "view", "'tilt'")} % 41 - 20 AS tilt FROM v),
p AS (SELECT *, sha256(concat_ws(chr(31), a, label, glyphs, width, height, tilt)) AS parameters_digest FROM w),
r AS (SELECT *, sha256(concat_ws(chr(31), '{G.VERSION}', record, parameters_digest)) AS digest FROM p)
"""


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey")


@query(f"WITH {RECORDS} SELECT record, label, glyphs, CAST(view AS INT) AS view, CAST(width AS INT) AS width, CAST(height AS INT) AS height, CAST(tilt AS INT) AS tilt, parameters_digest, digest FROM r")
def generated_records(spark: SparkSession, d: str) -> DataFrame:
    rows = G.generate(artifacts(spark, d), "p_partkey", CONFIG)
    return rows.select("record", "label", F.array_join("glyphs", " ").alias("glyphs"), "view", "width", "height", "tilt", "parameters_digest", "digest")


@query(f"""
WITH {RECORDS}
SELECT record, 'missing' AS problem FROM r WHERE k % 41 = 0 AND view = 1 UNION ALL SELECT record, 'changed' FROM r WHERE k % 50 = 3 AND NOT (k % 41 = 0 AND view = 1) UNION ALL SELECT record || 'x', 'never made' FROM r WHERE k % 60 = 1 AND view = 1
""")
def generated_anew(spark: SparkSession, d: str) -> DataFrame:
    """A table of which some records were changed, taken out and slipped in, against records made anew."""
    rows = G.generate(artifacts(spark, d), "p_partkey", CONFIG)
    k = F.col("artifact").cast("long")
    kept = rows.where(~((k % 41 == 0) & (F.col("view") == 1))).withColumn("digest", F.when(k % 50 == 3, F.reverse("digest")).otherwise(F.col("digest")))
    more = rows.where((k % 60 == 1) & (F.col("view") == 1)).withColumn("record", F.concat("record", F.lit("x")))
    return G.not_reproduced(kept.unionByName(more), artifacts(spark, d), "p_partkey", CONFIG)
