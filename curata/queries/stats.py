"""Counts, weights and samples over documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import scalars as S
from curata.operators import sampling
from curata.queries._registry import query, table

CLASSES = [("en", "trainable"), ("fr", "trainable"), ("de", "trainable"), ("es", "held_out"), ("it", "held_out")]


@query("SELECT 'lang' AS field, coalesce(lang, 'unknown') AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM documents GROUP BY 2")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return sampling.value_counts(table(spark, d, "documents"), ["lang", "source"])


@query("""
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, count(*) FILTER (WHERE value > 50) AS n_large, count(*) FILTER (WHERE value IS NULL) AS n_absent, count(DISTINCT user_id % 7) AS n_groups
FROM events GROUP BY event_type
""")
def audit_tallies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"), F.count_if(F.col("value") > 50).alias("n_large"), F.count_if(F.col("value").isNull()).alias("n_absent"), F.count_distinct(F.col("user_id") % 7).alias("n_groups"))


@query("""
WITH c(class_no, lang, status) AS (VALUES (0, 'en', 'trainable'), (1, 'fr', 'trainable'), (2, 'de', 'trainable'), (3, 'es', 'held_out'), (4, 'it', 'held_out')),
g AS (SELECT lang, count(DISTINCT source) AS n_groups, count(*) AS n_items FROM documents WHERE doc_id % 11 <> 0 GROUP BY lang)
SELECT class_no, lang, status, coalesce(n_groups, 0) AS n_groups, coalesce(n_items, 0) AS n_items FROM c LEFT JOIN g USING (lang)
""")
def class_availability(spark: SparkSession, d: str) -> DataFrame:
    return sampling.availability(table(spark, d, "documents"), "lang", "source", CLASSES, F.col("doc_id") % 11 == 0)


@query("WITH g AS (SELECT lang, count(DISTINCT sha256(text)) AS n_groups FROM documents GROUP BY lang) SELECT lang, n_groups, round((1.0 / n_groups) / (SELECT avg(1.0 / n_groups) FROM g), 9) AS weight FROM g")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", F.sha2("text", 256).alias("h"))
    return sampling.class_weights(docs, "lang", "h").withColumn("weight", F.round("weight", 9))


@query("""
WITH d AS (SELECT doc_id, lang, sha256(text) AS h FROM documents), a AS (SELECT lang, count(DISTINCT h) AS g FROM d GROUP BY lang), b AS (SELECT lang, h, count(*) AS n FROM d GROUP BY lang, h)
SELECT doc_id, round(CAST(1.0 AS DOUBLE) / g / n, 12) AS weight FROM d JOIN a USING (lang) JOIN b USING (lang, h)
""")
def sample_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    return sampling.sample_weights(docs, "doc_id", "lang", "h").withColumn("weight", F.round("weight", 12))


@query("""
WITH g AS (SELECT lang, count(DISTINCT sha256(text)) AS n_groups FROM documents WHERE lang IN ('en', 'fr', 'de') GROUP BY lang)
SELECT lang, n_groups, round(CAST(100.0 AS DOUBLE) * n_groups / (SELECT sum(n_groups) FROM g), 6) AS share FROM g
""")
def imbalance_table(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", F.sha2("text", 256).alias("h"))
    return sampling.imbalance(docs, "lang", "h", ["en", "fr", "de"]).withColumn("share", F.round("share", 6))


@query("WITH g AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1) SELECT n AS n_items, count(*) AS n_groups FROM g GROUP BY n")
def views_histogram(spark: SparkSession, d: str) -> DataFrame:
    return sampling.group_sizes(table(spark, d, "documents").select(F.sha2("text", 256).alias("h")), "h")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents) WHERE (i - 1) % 25 = 0")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.every_kth(table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], 25, ["lang"])


@query("""
WITH d AS (SELECT doc_id, lang, sha256(text) AS h FROM documents), g AS (SELECT lang, h, count(*) AS n FROM d GROUP BY lang, h), c AS (SELECT lang, count(*) AS n_h FROM g GROUP BY lang),
w AS (SELECT doc_id, CAST(floor((1.0e0 / n_h / n) * 1099511627776) AS BIGINT) AS w FROM d JOIN g USING (lang, h) JOIN c USING (lang)),
l AS (SELECT doc_id, w, CAST(sum(w) OVER (ORDER BY doc_id) AS BIGINT) AS upto FROM w WHERE w > 0),
p AS (SELECT CAST('0x' || substr(md5('7|' || i), 1, 15) AS BIGINT) % (SELECT max(upto) FROM l) AS pt FROM (SELECT unnest(range(500)) AS i))
SELECT doc_id, count(*) AS times FROM l JOIN p ON pt >= upto - w AND pt < upto GROUP BY doc_id
""")
def weighted_sampler(spark: SparkSession, d: str) -> DataFrame:
    """500 draws of documents, each language and each text of it as likely as any other."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    return sampling.weighted_sample(sampling.sample_weights(docs, "doc_id", "lang", "h"), "doc_id", "weight", 500)


@query("""
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type
""")
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    from curata.operators import metrics

    out = metrics.latency(table(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p95")], "max", F.round("std", 6).alias("std"))


@query("""
WITH v AS (SELECT event_type AS name, round(avg(value), 9) AS value FROM events GROUP BY event_type)
SELECT name, value, round((SELECT value FROM v WHERE name = 'click') - value, 6) AS drop_from_clean FROM v
""")
def robustness_delta(spark: SparkSession, d: str) -> DataFrame:
    from curata.operators import metrics

    v = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.round(F.avg("value"), 9).alias("value"))
    return metrics.deltas(v, "name", "value", "click").withColumn("drop_from_clean", F.round("drop_from_clean", 6))


@query("""
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2
""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """An extension: tumbling windows, the same on a stream."""
    from curata.streaming.ledger import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type")


@query("""
SELECT doc_id, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 100 THEN 'short' WHEN length(text) > 20000 THEN 'long' ELSE '' END
  || CASE WHEN n_chars <> length(text) THEN '|length' ELSE '' END AS flags,
  CASE WHEN length(text) >= 5000 THEN 'high' WHEN length(text) >= 1000 THEN 'moderate' WHEN length(text) >= 200 THEN 'low' ELSE 'very low' END AS confidence
FROM documents
""")
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    size = F.when(n == 0, "empty").when(n < 100, "short").when(n > 20000, "long").otherwise("")
    words = F.when(n >= 5000, "high").when(n >= 1000, "moderate").when(n >= 200, "low").otherwise("very low")
    return table(spark, d, "documents").select("doc_id", F.concat(size, F.when(F.col("n_chars") != n, "|length").otherwise("")).alias("flags"), words.alias("confidence"))


@query("""
SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g'))) AS n_text FROM pages
""")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", S.url_host(F.col("url")).alias("host"), F.length(S.strip_html(F.col("html"))).cast("long").alias("n_text"))
