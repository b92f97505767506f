"""Rules, joins and expressions around records, one query each, on tables made from documents, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import scalars as S
from curata.operators import governance as G
from curata.operators import reports as P
from curata.operators import rules as R
from curata.operators.evidence import CONFIDENCE
from curata.queries._registry import query, table
from curata.queries.governance import pick


@query("""
SELECT 'R2' AS rule, p_partkey AS record_index FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 13 <> 0
UNION ALL SELECT 'E2', p_partkey FROM part WHERE p_partkey % 11 = 0 AND p_partkey % 7 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0
""")
def file_rules(spark: SparkSession, d: str) -> DataFrame:
    """Records whose file is not there, or has another digest; some have no path, some no digest that says anything."""
    k = F.col("p_partkey")
    path, digest = F.when(k % 13 != 0, F.concat(F.lit("img/"), k.cast("string"))), F.sha2(k.cast("string"), 256)
    records = table(spark, d, "part").select(k.alias("i"), path.alias("image_path"), F.when(k % 17 == 0, "unknown").otherwise(digest).alias("image_sha256"))
    files = table(spark, d, "part").where("p_partkey % 7 <> 0").select(F.concat(F.lit("img/"), k.cast("string")).alias("path"), F.when(k % 11 == 0, F.reverse(digest)).otherwise(digest).alias("sha256"))
    return R.missing_files(records, "i", "image_path", files).unionByName(R.hash_mismatches(records, "i", "image_path", "image_sha256", files))


@query("""
WITH d AS (SELECT doc_id AS i FROM documents)
SELECT 'E4' AS rule, 'error' AS severity, 'schema_version' AS field, i AS record_index FROM d WHERE i % 6 = 0 UNION ALL SELECT 'R6', 'error', 'transcription', i FROM d WHERE i % 5 = 0 AND i % 3 = 0
UNION ALL SELECT 'R6', 'error', 'translation_en', i FROM d WHERE i % 5 = 0 AND i % 8 = 0 UNION ALL SELECT 'R11', 'error', 'redistributable', i FROM d WHERE i % 4 <> 1
UNION ALL SELECT 'R13', 'error', 'inscription_regions.1', i FROM d WHERE i % 9 = 0 UNION ALL SELECT 'R13', 'error', 'inscription_regions.2', i FROM d WHERE i % 10 = 0
""")
def export_rules(spark: SparkSession, d: str) -> DataFrame:
    """What an export asks of records beside record_rules: version, readings without a script, the right to pass on, regions within the image."""
    i = F.col("doc_id")
    say = lambda cond, text: F.when(cond, F.lit(text))
    region = lambda x, y, w: f'{{"x": {x}, "y": {y}, "w": {w}, "h": 10}}'
    second = F.when(i % 9 == 0, region(50, 0, 51)).otherwise(region(50, 0, 50))
    third = F.when(i % 10 == 0, region(0, 41, 5)).when(i % 10 == 1, region(0, 41, '"5"')).otherwise(region(0, 40, 5))
    parts = [
        F.when(i % 6 == 0, '"schema_version": "2.0"').otherwise('"schema_version": "1.4"'), F.when(i % 5 == 0, '"script_type": "none"').otherwise('"script_type": "a"'), say(i % 3 == 0, '"transcription": "ka"'), say(i % 8 == 0, '"translation_en": null'),
        say(i % 4 == 1, '"redistributable": "yes"'), say(i % 4 == 2, '"redistributable": "no"'), F.lit('"image_width_px": 100, "image_height_px": 50'), F.concat(F.lit(f'"inscription_regions": [{region(0, 0, 100)}, '), second, F.lit(", "), third, F.lit("]")),
    ]
    raw = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}"))
    found = R.record_findings(table(spark, d, "documents").select("doc_id", raw.alias("raw")), "doc_id", "raw", export_mode=True)
    return found.where(F.col("rule").isin("E4", "R6", "R11", "R13"))


@query("""
WITH e AS (SELECT event_id, event_id % 6 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'dataset_type' WHEN 1 THEN 'artifact_id' WHEN 2 THEN 'source' WHEN 3 THEN 'image_path' WHEN 4 THEN 'script_type,marker' ELSE '' END AS reasons FROM e
""")
def generated_traces(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 6
    rows = table(spark, d, "events").select(
        "event_id", F.when(k == 0, "synthetic").alias("dataset_type"), F.when(k == 1, "syn-7").otherwise("art-7").alias("artifact_id"), F.when(k == 2, "generator").otherwise("museum").alias("source"),
        F.when(k == 3, "data\\Synthetic\\a.png").otherwise("data/a.png").alias("image_path"), F.when(k == 4, "task_label").otherwise("a").alias("script_type"), F.when(k == 4, "MADE UP").alias("notes"))
    return rows.select("event_id", F.array_join(G.synthetic_reasons("SYN", "generator", "generated", ["task_label"], "MADE UP", rows.columns), ",").alias("reasons"))


@query("""
WITH r AS (SELECT sha256(text) AS h, source AS a FROM documents WHERE doc_id % 3 <> 0), g AS (SELECT h, count(DISTINCT a) AS n, min(a) AS a FROM r GROUP BY h)
SELECT doc_id, CASE WHEN n = 1 THEN g.a END AS artifact_id, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'known' END AS status FROM documents LEFT JOIN g ON sha256(text) = g.h
""")
def identified_photos(spark: SparkSession, d: str) -> DataFrame:
    """Documents by their digests among those of two thirds of them, whose source is their artifact."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    known = G.identify(docs.select("sha256").distinct(), docs.where("doc_id % 3 <> 0").select("sha256", F.col("source").alias("artifact_id")))
    return docs.join(known, "sha256").select("doc_id", "artifact_id", "status")


@query("SELECT doc_id AS image_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'mismatch' END AS problem FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def provenance_gaps(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), F.sha2("text", 256).alias("sha256"))
    there = docs.where("image_id % 5 <> 0").select("image_id", F.when(F.col("image_id") % 7 != 0, F.col("sha256")).alias("sha256"))
    return G.provenance_gaps(docs, there)


@query("""
SELECT sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1
""")
def fresh_records(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), "doc_id")
    return G.not_yet_known(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"))


@query("""
WITH g AS (SELECT user_id AS row, event_id AS cx, event_id % 4 AS w, 10 + event_id % 3 AS h FROM events),
x AS (SELECT *, cx - lag(cx) OVER o - (w + lag(w) OVER o) / 2 AS gap FROM g WINDOW o AS (PARTITION BY row ORDER BY cx)),
m AS (SELECT *, median(h) OVER (PARTITION BY row) AS mh, coalesce(median(gap) OVER (PARTITION BY row), 0) AS mg FROM x)
SELECT row, cx, CAST(sum(CASE WHEN gap > greatest(0.4::DOUBLE * mh, 1.8::DOUBLE * greatest(mg, 0.05::DOUBLE * mh)) THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY cx) AS BIGINT) AS word FROM m
""")
def glyph_words(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as glyphs along a row: where a gap starts a new word."""
    k = F.col("event_id")
    glyphs = table(spark, d, "events").select(F.col("user_id").alias("row"), k.alias("cx"), (k % 4).alias("w"), (k % 3 + 10).alias("h"))
    return G.words_by_gap(glyphs, "row").select("row", "cx", "word")


@query(r"""
SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS bare, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages
""")
def page_forms(spark: SparkSession, d: str) -> DataFrame:
    """A page without its tags, and its address as a name."""
    return table(spark, d, "pages").select("page_id", F.sha2(S.strip_html(F.col("html")), 256).alias("bare"), S.slug(F.col("url")).alias("slug"))


@query(r"""
WITH t AS (SELECT doc_id, array_to_string([x FOR x IN regexp_split_to_array(nfc_normalize(text), '\s+') IF x <> ''], ' ') AS t FROM documents)
SELECT doc_id, sha256(t) AS nfc, sha256(replace(lower(t), 'ß', 'ss')) AS reading FROM t
""")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts in normal form with single spaces, and folded as readings are compared."""
    return table(spark, d, "documents").select("doc_id", F.sha2(S.nfc("text"), 256).alias("nfc"), F.sha2(S.normalise_reading("text"), 256).alias("reading"))


@query("""
WITH p AS (SELECT p_partkey AS k, p_partkey % 801 - 400 AS y FROM part)
SELECT k AS p_partkey, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 'unknown' WHEN k % 3 = 0 THEN 'low' ELSE 'moderate' END AS lowest, y <> 0 AND y BETWEEN -300 AND 300 AS valid, CASE WHEN y <> 0 THEN abs(y) || CASE WHEN y < 0 THEN ' BCE' ELSE ' CE' END END AS label,
  CASE k % 3 WHEN 0 THEN 'com' WHEN 1 THEN 'src' ELSE 'met' END || '_' || k AS image_id FROM p
""")
def part_forms(spark: SparkSession, d: str) -> DataFrame:
    """The lowest of several confidences, years and their labels, and ids by source."""
    k = F.col("p_partkey")
    y = (k % 801 - 400).cast("int")
    words = F.when(k % 7 == 0, F.array(F.lit("odd"))).otherwise(F.array_compact(F.array(F.lit("moderate"), F.when(k % 5 == 0, "unknown"), F.when(k % 3 == 0, "low"), F.lit("odd"), F.lit("high"))))
    source = F.when(k % 3 == 0, "commons").when(k % 3 == 2, "met").otherwise("else")
    return table(spark, d, "part").select(
        "p_partkey", S.min_confidence(words, CONFIDENCE).alias("lowest"), S.valid_year(y, -300, 300).alias("valid"), F.when(y != 0, S.year_label(y)).alias("label"), P.source_image_id(source, k, {"commons": "com", "met": "met"}).alias("image_id"))


SCRIPTS = {"brahmi_unicode": "\U00011013\U00011014", "tamil_unicode": "கா", "romanized": "ka", "mixed": "ka க", "not_available": "12 ?"}


@query(f"SELECT event_id, [{', '.join(repr(s) for s in SCRIPTS)}][CAST(event_id % 5 + 1 AS INT)] AS script FROM events")
def reading_scripts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", G.script_of(pick(F.col("event_id"), list(SCRIPTS.values()))).alias("script"))


@query("""
SELECT c_custkey AS item, c_custkey % 9 = 0 AS in_pilot, CASE WHEN c_custkey % 4 = 0 THEN 'disputed' WHEN c_custkey % 4 = 1 THEN 'provisional' ELSE 'unannotated' END AS status,
  CASE WHEN c_custkey % 4 = 0 THEN 'adjudicate' WHEN c_custkey % 4 = 1 THEN NULL ELSE 'annotate' END AS next_step FROM customer
""")
def queue_steps(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    items = table(spark, d, "customer").select(k.alias("item"))
    status = table(spark, d, "customer").where("c_custkey % 4 < 2").select(k.alias("item"), F.when(k % 4 == 0, "disputed").otherwise("provisional").alias("status"))
    return G.annotation_queue(items, status, items.where("item % 9 = 0"), {"disputed": "adjudicate", "unannotated": "annotate"})


@query("""
WITH s AS (SELECT o_custkey AS item, o_orderkey, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['a', 'b', 'b'] WHEN 1 THEN ['b', 'c'] ELSE ['b', 'a'] END) AS k FROM orders), n AS (SELECT o_custkey AS item, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT x.item, x.k FROM (SELECT item, k, count(DISTINCT o_orderkey) AS m FROM s GROUP BY item, k) x JOIN n ON n.item = x.item AND n.n = x.m),
v AS (SELECT o_custkey AS item, o_orderstatus AS k, sum(o_orderkey % 5) AS w FROM orders GROUP BY 1, 2)
SELECT n.item, coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM c WHERE c.item = n.item), '') AS common, (SELECT string_agg(k, ',' ORDER BY k) FROM v WHERE v.item = n.item AND w = (SELECT max(w) FROM v x WHERE x.item = n.item)) AS voted FROM n
""")
def order_votes(spark: SparkSession, d: str) -> DataFrame:
    """Of each customer's orders: the categories that all of them allow, and those with the most weight."""
    k, o = F.col("o_orderkey"), table(spark, d, "orders")
    allowed = F.when(k % 3 == 0, F.array(*map(F.lit, "abb"))).when(k % 3 == 1, F.array(*map(F.lit, "bc"))).otherwise(F.array(*map(F.lit, "ba")))
    common = G.common_categories(o.select(F.col("o_custkey").alias("item"), allowed.alias("allowed")), "item", "allowed")
    votes = G.evidence_votes(o.select(F.col("o_custkey").alias("item"), "o_orderstatus", (k % 5).alias("w")), "item", "o_orderstatus", "w")
    voted = votes.groupBy("item").agg(F.array_join(F.array_sort(F.collect_list("o_orderstatus")), ",").alias("voted"))
    return common.join(voted, "item").select("item", F.array_join("categories", ",").alias("common"), "voted")
