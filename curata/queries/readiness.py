"""Detection over lines as boxes, gates and stages over documents, checks of generated records, and sentences and categories of codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import phrases as W
from curata.operators import evidence as E
from curata.operators import readiness as R
from curata.queries._registry import query, table

NOUNS, VERBS, NUMERALS = ["n1", "n2", "n3", "n4"], ["v1", "v2", "v3"], ["m1", "m2"]
CLASSES = dict.fromkeys(NOUNS, "N") | dict.fromkeys(VERBS, "V") | dict.fromkeys(NUMERALS, "#") | {"neg": "-"}


def detections(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Images are orders; truth: boxes of lines that are returned or accepted; predictions: boxes, moved a little, of lines of more than ten pieces. An image without truth is of the class unmarked.

    A line's number may come twice in an order, so a box's index is made of all its numbers.
    """
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    marked = line.groupBy("image").agg(F.bool_or(F.col("l_returnflag") != "N").alias("m"), F.max("l_linestatus").alias("s"))
    images = marked.select("image", F.when(F.col("m"), F.col("s")).otherwise("unmarked").alias("label"))
    line = line.drop("l_linestatus").distinct()
    i = (F.col("l_linenumber").cast("bigint") * 10**9 + F.col("l_partkey") * 10**4 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("bigint")).alias("i")
    x, y = F.col("l_partkey") * 7 % 50, (F.col("l_suppkey") * 3 % 50).cast("double")
    box = lambda shift: F.struct((x + F.col("l_linenumber") % 4 * shift).cast("double").alias("x"), y.alias("y"), (F.col("l_quantity") + 5).alias("w"), F.lit(20.0).alias("h")).alias("box")
    truth, pred = line.where("l_returnflag <> 'N'").select("image", i, box(0)), line.where("l_quantity > 10").select("image", i, box(3))
    return images, E.greedy_match(pred, truth, "image", "i", "box"), pred, truth


DETECTED = """
l AS (SELECT DISTINCT l_orderkey AS image, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag FROM lineitem),
b AS (SELECT image, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS i, CAST(l_partkey * 7 % 50 AS DOUBLE) AS x, CAST(l_partkey * 7 % 50 + l_linenumber % 4 * 3 AS DOUBLE) AS px, CAST(l_suppkey * 3 % 50 AS DOUBLE) AS y, l_quantity + 5 AS w,
  l_returnflag <> 'N' AS is_truth, l_quantity > 10 AS is_pred FROM l),
im AS (SELECT l_orderkey AS image, CASE WHEN bool_or(l_returnflag <> 'N') THEN max(l_linestatus) ELSE 'unmarked' END AS label FROM lineitem GROUP BY l_orderkey),
o AS (SELECT p.image, p.i AS pi, t.i AS ti, greatest(0, least(p.px + p.w, t.x + t.w) - greatest(p.px, t.x)) * greatest(0, least(p.y, t.y) + 20 - greatest(p.y, t.y)) AS inter, p.w * 20 + t.w * 20 AS area FROM b p JOIN b t USING (image) WHERE p.is_pred AND t.is_truth),
k AS (SELECT image, pi, ti, inter / (area - inter) AS v, row_number() OVER (PARTITION BY image ORDER BY inter / (area - inter) DESC, pi DESC, ti DESC) AS k FROM o WHERE inter / (area - inter) >= 0.5),
g(image, k, ps, ts, v, taken) AS (
  SELECT image, k, [pi], [ti], v, true FROM k WHERE k = 1
  UNION ALL
  SELECT k.image, k.k, CASE WHEN list_contains(g.ps, k.pi) OR list_contains(g.ts, k.ti) THEN g.ps ELSE list_append(g.ps, k.pi) END, CASE WHEN list_contains(g.ps, k.pi) OR list_contains(g.ts, k.ti) THEN g.ts ELSE list_append(g.ts, k.ti) END,
    k.v, NOT (list_contains(g.ps, k.pi) OR list_contains(g.ts, k.ti)) FROM g JOIN k ON k.image = g.image AND k.k = g.k + 1
),
c AS (SELECT image, count(*) FILTER (WHERE is_truth) AS t, count(*) FILTER (WHERE is_pred) AS p FROM b GROUP BY image)
"""


@query(f"""
WITH RECURSIVE {DETECTED}, th(threshold) AS (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.75 AS DOUBLE))),
m AS (SELECT threshold, image, count(*) AS m, sum(v) AS s FROM g, th WHERE taken AND v >= threshold GROUP BY threshold, image),
r AS (SELECT th.threshold, CAST(sum(coalesce(m, 0)) AS BIGINT) AS tp, CAST(sum(p - coalesce(m, 0)) AS BIGINT) AS fp, CAST(sum(t - coalesce(m, 0)) AS BIGINT) AS fn, count(*) FILTER (WHERE coalesce(m, 0) < t) AS n_missed_images, sum(s) AS s FROM th, c LEFT JOIN m ON m.image = c.image AND m.threshold = th.threshold GROUP BY th.threshold)
SELECT threshold, tp, fp, fn, n_missed_images, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round(s / tp, 9) AS mean_iou FROM r
""")
def detection_thresholds(spark: SparkSession, d: str) -> DataFrame:
    images, matches, pred, truth = detections(spark, d)
    out = R.detection_by_threshold(images, matches, pred, truth, "image")
    return out.select("threshold", "tp", "fp", "fn", "n_missed_images", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "mean_iou")])


@query(f"""
WITH RECURSIVE {DETECTED}, m AS (SELECT image, count(*) AS m FROM g WHERE taken GROUP BY image),
r AS (SELECT label, count(*) AS n_images, CAST(sum(coalesce(m, 0)) AS BIGINT) AS tp, CAST(sum(p - coalesce(m, 0)) AS BIGINT) AS fp, CAST(sum(t - coalesce(m, 0)) AS BIGINT) AS fn, avg(CASE WHEN p > 0 THEN 1.0 ELSE 0 END) AS alarm_rate FROM im JOIN c USING (image) LEFT JOIN m USING (image) GROUP BY label)
SELECT label, n_images, tp, fp, fn, round(alarm_rate, 9) AS alarm_rate, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
  round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM r
""")
def detection_classes(spark: SparkSession, d: str) -> DataFrame:
    images, matches, pred, truth = detections(spark, d)
    out = R.detection_by_class(images, matches, pred, truth, "image", "label")
    return out.select("label", "n_images", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("alarm_rate", "precision", "recall", "f1")])


@query("""
WITH r AS (SELECT doc_id, source, lang, lang IN ('en', 'de', 'fr') AND doc_id % 5 <> 0 AS el, doc_id % 97 = 3 AS uns, doc_id % 2 = 0 AS ok FROM documents), c AS (SELECT lang, count(DISTINCT source) AS m FROM r WHERE lang IN ('en', 'de', 'fr') GROUP BY lang),
n AS (SELECT count(*) > 0 AS has_rows, count(*) FILTER (WHERE el) AS el, count(*) FILTER (WHERE el AND uns) AS uns, count(*) FILTER (WHERE el AND NOT ok) AS bad, (SELECT count(*) FROM c) AS present, (SELECT count(*) FROM c WHERE m >= 2) AS enough, (SELECT count(*) FROM pages) AS images FROM r),
g(gate_no, gate, ok) AS (
  SELECT 1, 'canonical source', true UNION ALL SELECT 2, 'records exist', has_rows FROM n UNION ALL SELECT 3, 'image files exist', images > 0 FROM n UNION ALL SELECT 4, 'validation passes', (SELECT count(*) = 0 FROM documents WHERE doc_id % 50 = 1) UNION ALL SELECT 5, 'every record loads', true
  UNION ALL SELECT 6, 'no photograph under two groups', (SELECT count(*) = 0 FROM documents WHERE doc_id % 50 = 1 AND doc_id % 3 = 0) UNION ALL SELECT 7, 'labels have a source', el > 0 AND uns = 0 FROM n UNION ALL SELECT 8, 'use is permitted', el > 0 AND bad = 0 FROM n
  UNION ALL SELECT 9, 'every class is present', present = 3 FROM n UNION ALL SELECT 10, 'enough groups a class', enough = 3 FROM n UNION ALL SELECT 11, 'verified split', true)
SELECT CAST(gate_no AS INT) AS gate_no, gate, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS result FROM g
""")
def readiness_gates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    r = table(spark, d, "documents").select("doc_id", "source", "lang", F.when(k % 97 != 3, "expert_annotation").alias("label_source"), F.when(k % 2 == 0, "yes").otherwise("unknown").alias("usable"))
    findings = r.where("doc_id % 50 = 1").select(F.when(k % 3 == 0, "R4").otherwise("R1").alias("rule"), F.lit("error").alias("severity"))
    return R.readiness_gates(r, findings, r.where("doc_id < 0"), table(spark, d, "pages"), r.where("doc_id < 0"), ["en", "de", "fr"], 2, True, "source", "lang", "label_source", "usable", F.col("lang").isin("en", "de", "fr") & (k % 5 != 0))


@query("""
WITH n AS (SELECT count(*) AS r, count(*) FILTER (WHERE n_chars > 0) AS p FROM documents), l AS (SELECT count(*) AS h FROM labels)
SELECT CAST(i AS INT) AS gate_no, gate, result FROM (
  SELECT 1 AS i, 'raw data' AS gate, CASE WHEN r > 0 AND p = r THEN 'PASS' ELSE 'BLOCKED' END AS result FROM n UNION ALL SELECT 2, 'provenance', CASE WHEN r > 0 THEN 'PASS' ELSE 'BLOCKED' END FROM n UNION ALL SELECT 3, 'schema', CASE WHEN r > 0 THEN 'PASS' ELSE 'BLOCKED' END FROM n
  UNION ALL SELECT 4, 'image hashes', CASE WHEN r > 0 THEN 'PASS' ELSE 'BLOCKED' END FROM n UNION ALL SELECT 5, 'preprocessing', CASE WHEN p > 0 AND p = r THEN 'PASS' ELSE 'BLOCKED' END FROM n UNION ALL SELECT 6, 'annotations', CASE WHEN h > 0 THEN 'PASS' ELSE 'WAITING' END FROM l
  UNION ALL SELECT 7, 'expert agreement', 'WAITING' UNION ALL SELECT 8, 'promotion', 'WAITING' UNION ALL SELECT 9, 'split', 'PASS' UNION ALL SELECT 10, 'training', 'WAITING' UNION ALL SELECT 11, 'evaluation', 'WAITING')
""")
def workflow_stages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    marks = [(F.lit(True), "records", None), (F.col("n_chars") > 0, "present", None), (~F.coalesce(F.col("n_chars") > 0, F.lit(False)), "undecoded", None)]
    numbers = R.tally(docs, marks).unionByName(R.tally(table(spark, d, "labels"), [(F.lit(True), "humans", None), (F.lit(True), "round_items", None)]))
    one = spark.createDataFrame([("split_ok", "", 1)], "metric string, key string, n bigint")
    return R.workflow_stages(numbers.unionByName(one))


def generated(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    record = F.when(k % 31 == 0, F.concat("source", F.lit("-V0"))).when(k % 23 == 0, F.concat(F.lit("V"), k.cast("string"))).otherwise(F.concat("source", F.lit("-V"), k.cast("string")))
    return table(spark, d, "documents").select(
        k.alias("index"), record.alias("record"), F.col("source").alias("group"), F.col("lang").alias("label"), F.when(k % 19 == 0, "no").otherwise("yes").alias("present"), F.sha2("text", 256).alias("digest"), F.concat(F.lit("img/"), k.cast("string")).alias("path"),
        (F.col("n_chars") + F.when(k % 47 == 0, 1).otherwise(0)).cast("string").alias("target"), F.length("text").cast("string").alias("length"), F.when(k % 53 == 0, "1.0").otherwise("1.1").alias("version"))


def generated_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "documents").select(F.concat(F.when(k % 37 == 0, "old/").otherwise("img/"), k.cast("string")).alias("path"), F.when(k % 41 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("text", 256)).alias("digest"))


GENERATED = """
r AS (SELECT doc_id AS index, CASE WHEN doc_id % 31 = 0 THEN source || '-V0' WHEN doc_id % 23 = 0 THEN 'V' || doc_id ELSE source || '-V' || doc_id END AS record, source AS "group", lang AS label, sha256(text) AS digest, n_chars + CASE WHEN doc_id % 47 = 0 THEN 1 ELSE 0 END <> length(text) AS other, doc_id FROM documents),
f AS (
  SELECT 'S1' AS rule, record, "group" FROM r WHERE index % 59 = 0
  UNION ALL SELECT 'S2', record, "group" FROM r QUALIFY index > min(index) OVER (PARTITION BY record) UNION ALL SELECT 'S2', record, "group" FROM r WHERE NOT starts_with(record, "group" || '-V')
  UNION ALL SELECT 'S3', record, "group" FROM r WHERE doc_id % 37 = 0 OR doc_id % 41 = 0 UNION ALL SELECT 'S4', record, "group" FROM (SELECT * FROM r QUALIFY index > min(index) OVER (PARTITION BY digest))
  UNION ALL SELECT 'S5', NULL, "group" FROM r GROUP BY "group" HAVING count(DISTINCT label) > 1 UNION ALL SELECT 'S6', record, "group" FROM r WHERE (label = 'en' AND doc_id % 19 = 0) OR (label = 'de' AND doc_id % 19 <> 0) UNION ALL SELECT 'S7', record, "group" FROM r WHERE other)
"""


def found(spark: SparkSession, d: str) -> DataFrame:
    return R.generated_findings(generated(spark, d), generated_files(spark, d), {"en": "yes", "de": "no"}, F.col("index") % 59 == 0, F.col("length"))


@query(f'WITH {GENERATED} SELECT rule, record, "group" FROM f')
def generated_findings(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d)


@query("SELECT greatest(a.lang, b.lang) AS part_b, least(a.lang, b.lang) AS part_a, count(*) AS n FROM (SELECT DISTINCT lang, source FROM documents) a JOIN (SELECT DISTINCT lang, source FROM documents) b ON a.source = b.source AND a.lang < b.lang GROUP BY 1, 2")
def partition_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return R.partition_overlaps(table(spark, d, "documents"), "lang", "source")


@query("SELECT 'img/' || doc_id AS path, 'missing' AS problem FROM documents WHERE doc_id % 37 = 0 UNION ALL SELECT 'old/' || doc_id, 'unrecorded' FROM documents WHERE doc_id % 37 = 0")
def file_differences(spark: SparkSession, d: str) -> DataFrame:
    return R.file_differences(generated(spark, d), generated_files(spark, d), "path")


@query(f"""
WITH {GENERATED}, n(c, n) AS (
  SELECT 'V1', 0 UNION ALL SELECT 'V2', (SELECT count(*) FROM documents WHERE starts_with(source, 'synthetic')) UNION ALL SELECT 'V3', 0 UNION ALL SELECT 'V4', count(*) FROM f WHERE rule = 'S1' UNION ALL SELECT 'V5', count(*) FROM f WHERE rule = 'S2' UNION ALL SELECT 'V6', count(*) FROM f WHERE rule = 'S3'
  UNION ALL SELECT 'V7', count(*) FROM f WHERE rule = 'S4' UNION ALL SELECT 'V8', count(*) FROM f WHERE rule IN ('S5', 'S6') UNION ALL SELECT 'V9', count(*) FROM (SELECT label FROM r GROUP BY label HAVING count(DISTINCT "group") <> 5)
  UNION ALL SELECT 'V10', 2 * count(*) FROM r WHERE doc_id % 37 = 0 UNION ALL SELECT 'V11', count(*) FROM (SELECT DISTINCT a.label, b.label FROM r a JOIN (SELECT DISTINCT label, "group" FROM r) b ON a."group" = b."group" AND a.label < b.label) UNION ALL SELECT 'V13', count(*) FROM r WHERE doc_id % 53 = 0)
SELECT c AS "check", n, n = 0 AS passed FROM n
""")
def generated_checks(spark: SparkSession, d: str) -> DataFrame:
    r, none = generated(spark, d), table(spark, d, "documents").where("doc_id < 0")
    foreign = {"files": none, "records": table(spark, d, "documents").where("startswith(source, 'synthetic')"), "annotations": none}
    return R.generated_checks(found(spark, d), r, R.file_differences(r, generated_files(spark, d), "path"), R.partition_overlaps(r, "label", "group"), foreign, 5, "1.1")


@query("""
SELECT event_id, CASE WHEN value >= 90 THEN 'high model confidence' WHEN value >= 70 THEN 'moderate model confidence' WHEN value >= 50 THEN 'low model confidence' WHEN value IS NOT NULL THEN 'very low model confidence: the model is unsure' END AS words,
  CASE WHEN event_id % 3 = 0 THEN 'no_engine' WHEN event_id % 4 <> 0 AND value >= 90 THEN 'candidate' ELSE 'no_reliable_transcription' END AS status, CASE WHEN event_id % 3 = 0 THEN ' ' || event_type WHEN event_id % 4 <> 0 AND value >= 90 THEN event_type END AS text FROM events
""")
def score_words(spark: SparkSession, d: str) -> DataFrame:
    k, score = F.col("event_id"), F.col("value") / 100
    status = F.when(k % 3 == 0, "no_engine").otherwise("candidate")
    text = F.when((k % 4 == 0) & (k % 3 != 0), "  ").otherwise(F.concat(F.lit(" "), "event_type"))
    return table(spark, d, "events").select("event_id", W.confidence_words(score).alias("words"), W.screen_reading(status, text, score).alias("s")).select("event_id", "words", "s.*")


@query("""
WITH c AS (SELECT event_id, [['s', 'm', 'x', 'q'][event_id % 4 + 1], ['x', 's', 'm'][event_id % 3 + 1]] AS a, CASE WHEN event_id % 5 < 3 THEN [['m', 's', 'x', 'q', 'm'][user_id % 5 + 1]] END AS b FROM events),
w AS (SELECT event_id, CASE WHEN b IS NULL THEN [a] ELSE [a, b] END AS ws, event_id % 2 = 0 AS sym FROM c), k AS (SELECT *, list_filter(flatten(ws), lambda x: x <> 'q') AS ks FROM w),
r AS (SELECT event_id, CASE WHEN len(ks) = 0 AND sym THEN 1 WHEN len(ks) = 0 THEN 2 WHEN len(list_filter(ks, lambda x: x <> 'x')) = 0 THEN 3 WHEN ws[2][1] = 'm' THEN 4 WHEN ks[-1] = 'm' THEN 5 ELSE 6 END AS i FROM k)
SELECT event_id, ['R0', 'R0', 'R1', 'R2', 'R3', 'R4'][i] AS rule, ['symbolic_mark_like', 'no_reading', 'numeral_like', 'name_and_title_like', 'ownership_formula_like', 'personal_name_like'][i] AS category FROM r
""")
def sequence_category(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    code = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    a, b = F.array(code(["s", "m", "x", "q"], k), code(["x", "s", "m"], k)), F.array(code(["m", "s", "x", "q", "m"], F.col("user_id")))
    words = F.when(k % 5 < 3, F.array(a, b)).otherwise(F.array(a))
    return table(spark, d, "events").select("event_id", W.sequence_category(words, {"s": "stem", "m": "marker", "x": "numeral_like"}, k % 2 == 0).alias("r")).select("event_id", "r.*")


@query("SELECT event_id, event_id % 15 AS n, CASE WHEN event_id % 15 < 3 THEN 'insufficient_evidence' ELSE 'translated' END AS status, CAST(CASE WHEN event_id % 15 < 3 THEN NULL ELSE event_id % 15 END AS INT) AS n_translated FROM events")
def sampled_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences drawn by an event's number: the grammar's decoder must translate every one whole, whatever was drawn."""
    n = F.col("event_id") % 15
    s = table(spark, d, "events").select("event_id", n.alias("n"), W.sentence(F.col("event_id"), n, NOUNS, VERBS, NUMERALS, "neg").alias("codes"))
    return s.select("event_id", "n", E.decode(F.col("codes"), CLASSES).alias("x")).select("event_id", "n", "x.status", "x.n_translated")
