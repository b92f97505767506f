"""Predictions: probabilities made from the first four components of an embedding; truth is its label (0 to 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import scalars as S
from curata.operators import metrics as M
from curata.queries._registry import query, table


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, y, p: whole hundredths of squared components, so that both engines see equal numbers; p sums to 1 where any is not 0."""
    e = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 4).cast("int").alias("y"), F.slice("embedding", 1, 4).alias("e"))
    parts = F.transform("e", lambda x: F.floor(F.abs(x.cast("double")) * 100) + 1)
    e = e.withColumn("q", parts).withColumn("t", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x))
    return e.select("vec_id", "y", F.transform("q", lambda x: x.cast("double") / F.col("t")).alias("p"))


P = """
e AS (SELECT vec_id, CAST(label % 4 AS INT) AS y, [CAST(floor(abs(CAST(x AS DOUBLE)) * 100) AS BIGINT) + 1 FOR x IN embedding[1:4]] AS q FROM embeddings),
pr AS (SELECT vec_id, y, [CAST(x AS DOUBLE) / CAST(list_sum(q) AS DOUBLE) FOR x IN q] AS p FROM e),
pp AS (SELECT *, CAST(list_position(p, list_max(p)) - 1 AS INT) AS yp, list_max(p) AS conf FROM pr)
"""
PER_CLASS = """
k AS (SELECT unnest([0, 1, 2, 3]) AS label),
c AS (SELECT label, (SELECT count(*) FROM pp WHERE y = label) AS s, (SELECT count(*) FROM pp WHERE yp = label) AS p, (SELECT count(*) FROM pp WHERE yp = label AND y = label) AS t FROM k),
f AS (SELECT *, CASE WHEN p > 0 THEN t / p WHEN s > 0 THEN 0.0 END AS precision, CASE WHEN s > 0 THEN t / s END AS recall FROM c),
f1 AS (SELECT *, CASE WHEN precision IS NULL OR recall IS NULL THEN NULL WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM f)
"""


def predicted(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).withColumn("yp", S.argmax(F.col("p")))


@query(f"WITH {P} SELECT y AS y_true, yp AS y_pred, count(*) AS n FROM pp GROUP BY y, yp")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(predicted(spark, d), "y", "yp")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(f"WITH {P}, {PER_CLASS} SELECT label, s AS support, p AS predicted, t AS true_positives, round(CAST(precision AS DOUBLE), 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f1")
def per_class_prf(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.per_class(confusion_matrix(spark, d), range(4)), "precision", "recall", "f1")


@query(f"""
WITH {P}, {PER_CLASS}
SELECT CAST(sum(s) AS BIGINT) AS n_samples, round(sum(t) / sum(s), 9) AS accuracy, round(avg(precision) FILTER (WHERE s > 0), 9) AS macro_precision, round(avg(recall) FILTER (WHERE s > 0), 9) AS macro_recall,
  round(avg(f1) FILTER (WHERE s > 0), 9) AS macro_f1, round(sum(f1 * s) FILTER (WHERE s > 0) / sum(s), 9) AS weighted_f1, count(*) FILTER (WHERE s = 0) AS n_without_support FROM f1
""")
def macro_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.macro(M.per_class(confusion_matrix(spark, d), range(4))), "accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")


@query(f"""
WITH {P}, r AS (SELECT vec_id, y, i - 1 AS i, row_number() OVER (PARTITION BY vec_id ORDER BY p[i] DESC, i) AS k FROM pr, (SELECT unnest([1, 2, 3, 4]) AS i))
SELECT count(DISTINCT vec_id) AS n, count(*) FILTER (WHERE k <= 2 AND i = y) AS hits, round(count(*) FILTER (WHERE k <= 2 AND i = y) / count(DISTINCT vec_id), 9) AS accuracy FROM r
""")
def topk_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.top_k_accuracy(predictions(spark, d), "y", "p", 2, 4), "accuracy")


BINS = """
b AS (SELECT i AS bin, CAST(i AS DOUBLE) / 10 AS low, CAST(i + 1 AS DOUBLE) / 10 AS high FROM (SELECT unnest(range(10)) AS i)),
c AS (SELECT CASE WHEN conf > 0.9e0 THEN 9 WHEN conf > 0.8e0 THEN 8 WHEN conf > 0.7e0 THEN 7 WHEN conf > 0.6e0 THEN 6 WHEN conf > 0.5e0 THEN 5 WHEN conf > 0.4e0 THEN 4 WHEN conf > 0.3e0 THEN 3 WHEN conf > 0.2e0 THEN 2 WHEN conf > 0.1e0 THEN 1 ELSE 0 END AS bin,
  count(*) AS n, avg(CAST(y = yp AS INT)) AS accuracy, avg(conf) AS mean_confidence FROM pp GROUP BY 1),
bb AS (SELECT CAST(bin AS INT) AS bin, low, high, coalesce(n, 0) AS n, accuracy, mean_confidence, abs(accuracy - mean_confidence) AS gap FROM b LEFT JOIN c USING (bin))
"""


@query(f"WITH {P}, {BINS} SELECT bin, low, high, n, round(accuracy, 9) AS accuracy, round(mean_confidence, 9) AS mean_confidence, round(gap, 9) AS gap FROM bb")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.calibration(predictions(spark, d), "y", "p"), "accuracy", "mean_confidence", "gap")


@query(f"WITH {P}, {BINS} SELECT CAST(sum(n) AS BIGINT) AS n_samples, round(sum(gap * n) / sum(n), 9) AS ece, round(max(gap), 9) AS mce FROM bb")
def calibration_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.calibration_summary(M.calibration(predictions(spark, d), "y", "p")), "ece", "mce")


@query(f"WITH {P} SELECT round(avg(list_sum([pow(p[i] - CASE WHEN i - 1 = y THEN 1 ELSE 0 END, 2) FOR i IN [1, 2, 3, 4]])), 9) AS brier FROM pr")
def brier_score(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.brier(predictions(spark, d), "y", "p"), "brier")


@query(f"WITH {P} SELECT round(-avg(ln(p[y + 1])), 9) AS nll FROM pr")
def nll(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.negative_log_likelihood(predictions(spark, d), "y", "p"), "nll")


@query()
def temperature_fit(spark: SparkSession, d: str) -> DataFrame:
    t = M.fit_temperature(predictions(spark, d), "y", "p")
    return M.negative_log_likelihood(predictions(spark, d), "y", "p", t).withColumn("temperature", F.lit(t))


@query(f"""
WITH {P}, b AS (SELECT unnest([0, 1, 2, 3]) AS bin),
c AS (SELECT CASE WHEN conf < 0.4e0 THEN 0 WHEN conf < 0.6e0 THEN 1 WHEN conf < 0.8e0 THEN 2 WHEN conf < 1.0001e0 THEN 3 END AS bin, count(*) AS n, count(*) FILTER (WHERE y = yp) AS n_correct FROM pp GROUP BY 1)
SELECT bin, coalesce(n, 0) AS n, coalesce(n_correct, 0) AS n_correct, round(CASE WHEN n > 0 THEN n_correct / n END, 9) AS accuracy FROM b LEFT JOIN c USING (bin)
""")
def error_bins(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.confidence_bins(predictions(spark, d), "y", "p"), "accuracy")


@query(f"WITH {P} SELECT vec_id AS item, y AS y_true, yp AS y_pred, round(conf, 9) AS confidence FROM pp WHERE y <> yp")
def error_analysis(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.errors(predictions(spark, d), "vec_id", "y", "p"), "confidence")


@query(f"""
WITH {P} SELECT vec_id % 25 AS grp, CAST(i - 1 AS INT) AS pos, round(avg(p[i]), 9) AS mean_prob, count(*) AS n, min(y) = max(y) AS consistent FROM pr, (SELECT unnest([1, 2, 3, 4]) AS i) GROUP BY 1, 2
""")
def group_mean_prob(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.group_mean(predictions(spark, d).withColumn("g", F.col("vec_id") % 25), "g", "y", "p"), "mean_prob")


@query("SELECT quality AS y_true, 1 - toxic AS y_pred, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion_labels(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(table(spark, d, "labels").withColumn("b", 1 - F.col("toxic")), "quality", "b")


@query("""
WITH p AS (SELECT coalesce(CAST(quality AS VARCHAR), 'unknown') AS a, coalesce(CAST(1 - toxic AS VARCHAR), 'unknown') AS b FROM labels), k AS (SELECT * FROM p WHERE a NOT IN ('unknown', 'not_available') AND b NOT IN ('unknown', 'not_available')),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS n_agree, (SELECT count(*) FROM p) - count(*) AS n_excluded FROM k),
e AS (SELECT coalesce(sum(x.c * y.c), 0) AS pe FROM (SELECT a, count(*) AS c FROM k GROUP BY a) x JOIN (SELECT b, count(*) AS c FROM k GROUP BY b) y ON x.a = y.b),
r AS (SELECT n, n_agree, n_excluded, CAST(n_agree AS DOUBLE) / nullif(n, 0) AS po, CAST(pe AS DOUBLE) / nullif(n * n, 0) AS pe FROM n, e)
SELECT n, n_agree, n_excluded, round(po, 9) AS raw_agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 9) AS kappa,
  CASE WHEN n = 0 THEN 'no_data' WHEN NOT coalesce(pe < 1, false) THEN 'undefined' WHEN n < 30 THEN 'insufficient_sample' ELSE 'ok' END AS status FROM r
""")
def kappa_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select(F.col("quality").cast("string").alias("a1"), (1 - F.col("toxic")).cast("string").alias("b1"))
    return _rounded(M.kappa(labels, "a1", "b1"), "raw_agreement", "kappa")


@query("""
WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS a, list(DISTINCT l_linestatus) AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 9) AS jaccard FROM s
""")
def jaccard_sets(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    return _rounded(g.select("l_orderkey", M.jaccard(F.col("a"), F.col("b")).alias("jaccard")), "jaccard")


def read_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Reference: a part's name with its size; hypothesis: the name with one letter changed, cut, none, or as it was. ASCII, as DuckDB counts bytes."""
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("r"))
    m = F.col("p_partkey") % 5
    h = F.when(m == 0, F.col("r")).when(m == 1, F.translate("r", "ae", "ei")).when(m == 2, F.substring("r", 1, 4)).when(m == 3, "").otherwise(F.concat("r", F.lit(" x")))
    return p.select("p_partkey", "r", h.alias("h"))


PAIRS = """
p0 AS (SELECT p_partkey, p_name || ' ' || CAST(p_size AS VARCHAR) AS r FROM part),
p AS (SELECT p_partkey, r, CASE p_partkey % 5 WHEN 0 THEN r WHEN 1 THEN translate(r, 'ae', 'ei') WHEN 2 THEN substr(r, 1, 4) WHEN 3 THEN '' ELSE r || ' x' END AS h FROM p0),
t0 AS (SELECT *, CASE WHEN h <> '' THEN levenshtein(r, h) / length(r) END AS cer FROM p),
t AS (SELECT *, CASE WHEN cer IS NULL THEN 'no_output' WHEN cer = 0 THEN 'exact' WHEN cer < 0.5 THEN 'partial' ELSE 'wrong' END AS bucket FROM t0)
"""


@query(f"""
WITH {PAIRS}
SELECT count(*) AS n_references, round(avg(cer), 9) AS cer_macro, round(sum(levenshtein(r, h)) FILTER (WHERE cer IS NOT NULL) / sum(length(r)) FILTER (WHERE cer IS NOT NULL), 9) AS cer_micro,
  count(*) FILTER (WHERE bucket = 'exact') AS n_exact, count(*) FILTER (WHERE bucket = 'partial') AS n_partial, count(*) FILTER (WHERE bucket = 'wrong') AS n_wrong, count(*) FILTER (WHERE bucket = 'no_output') AS n_no_output,
  round(count(*) FILTER (WHERE bucket = 'exact') / count(*), 9) AS exact_of_all, round(count(*) FILTER (WHERE bucket = 'exact') / count(cer), 9) AS exact_of_answered, round(count(cer) / count(*), 9) AS coverage FROM t
""")
def cer_report(spark: SparkSession, d: str) -> DataFrame:
    out = M.text_report(M.text_rates(read_pairs(spark, d), "r", "h"), "r", "h")
    return _rounded(out, "cer_macro", "cer_micro", "exact_of_all", "exact_of_answered", "coverage")


@query(f"WITH {PAIRS} SELECT p_partkey, round(cer, 9) AS cer, bucket FROM t")
def ocr_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.text_rates(read_pairs(spark, d), "r", "h"), "cer").select("p_partkey", "cer", "bucket")


@query(f"""
WITH {PAIRS},
w AS (SELECT p_partkey, [x FOR x IN string_split(r, ' ') IF x <> ''] AS a, [x FOR x IN string_split(h, ' ') IF x <> ''] AS b FROM p WHERE h <> ''),
l AS (SELECT *, list_distinct(list_concat(a, b)) AS every FROM w),
e AS (SELECT p_partkey, len(a) AS n, levenshtein(array_to_string([chr(CAST(64 + list_position(every, x) AS INT)) FOR x IN a], ''), array_to_string([chr(CAST(64 + list_position(every, x) AS INT)) FOR x IN b], '')) AS d FROM l)
SELECT p_partkey, CAST(d AS INT) AS word_errors, round(d / n, 9) AS wer FROM e
""")
def wer_words(spark: SparkSession, d: str) -> DataFrame:
    """Word errors between a part's name and its variant. In SQL the words of a pair, a dozen at most, stand for letters, as DuckDB's distance counts bytes."""
    p = read_pairs(spark, d).where("h <> ''")
    return p.select("p_partkey", S.word_distance(F.col("r"), F.col("h")).alias("word_errors"), F.round(S.word_error_rate(F.col("r"), F.col("h")), 9).alias("wer"))
