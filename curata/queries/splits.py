"""Splits of documents: group sha256(text), label lang, stratum source of the first document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.operators import splits
from curata.operators.splits import deal_plan
from curata.queries._registry import query, table
from curata.queries.identity import SIMHASH, hashes, near_components, representatives

CLASSES, HELD_OUT = ["en", "fr", "de"], ["es"]
NAMES, RATIOS = ["train", "val", "test"], [0.7, 0.15, 0.15]
FOLDS = [f"fold_{i}" for i in range(5)]


def grouped(spark: SparkSession, d: str) -> DataFrame:
    """grp, label, stratum, n_items."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("grp"), "lang", "source")
    return docs.groupBy("grp").agg(F.min("lang").alias("label"), F.min_by("source", "doc_id").alias("stratum"), F.count(F.lit(1)).alias("n_items"))


ELIGIBLE = """
v AS (
  SELECT d.source, d.doc_id, d.lang, CASE WHEN l.toxic = 1 THEN false WHEN d.lang IN ('es') THEN false WHEN d.lang IN ('en', 'fr', 'de') THEN true ELSE false END AS ok,
    CASE WHEN l.toxic = 1 THEN 'split=excluded (toxic)' WHEN d.lang IN ('es') THEN 'held_out_label:' || d.lang WHEN d.lang IN ('en', 'fr', 'de') THEN 'eligible' ELSE 'label ' || coalesce(d.lang, 'None') || ' not in class specification' END AS reason
  FROM documents d LEFT JOIN labels l USING (doc_id)
)
"""


@query(f"""
WITH {ELIGIBLE}, g AS (SELECT source || '/' || lang AS grp, bool_and(ok) AS a, bool_or(ok) AS o, min(lang) AS l0, max(lang) AS l1, count(*) AS n_items, min(doc_id) AS first_item, min(reason) AS why FROM v GROUP BY 1)
SELECT grp, CASE WHEN NOT o THEN 'excluded' WHEN NOT a THEN 'mixed_verdict' WHEN l0 <> l1 THEN 'mixed_label' ELSE 'eligible' END AS status,
  CASE WHEN a AND l0 = l1 THEN l0 END AS label, n_items, first_item, CASE WHEN NOT o THEN why END AS excluded_reason
FROM g
""")
def eligible_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    split = F.when(F.col("toxic") == 1, "excluded")
    rows = docs.select("doc_id", "lang", F.concat_ws("/", "source", "lang").alias("grp"), splits.eligibility(F.col("lang"), split, F.lit("toxic"), CLASSES, HELD_OUT).alias("v"))
    return splits.eligible_groups(rows, "grp", "doc_id", "lang", "v")


@query("""
WITH g AS (SELECT count(*) FILTER (WHERE lang = 'en') AS a, count(*) FILTER (WHERE lang = 'fr') AS b, count(*) FILTER (WHERE lang = 'de') AS c FROM (SELECT DISTINCT sha256(text), lang FROM documents))
SELECT CASE WHEN least(a, b, c) >= 20 THEN 'holdout' ELSE 'grouped_kfold' END AS strategy, CASE WHEN least(a, b, c) >= 20 OR least(a, b, c) >= 5 THEN '' ELSE 'k-fold needs 5 groups a class' END AS problems FROM g
""")
def check_splittable(spark: SparkSession, d: str) -> DataFrame:
    return splits.splittable(grouped(spark, d), "label", CLASSES, 20, 5)


def _split_sql(names: list[str], ratios: list[float]) -> str:
    plan = deal_plan(ratios, 200)
    rows = ", ".join(f"({i}, '{names[p]}')" for i, p in enumerate(plan))
    return f"""
deal(i, partition) AS (VALUES {rows}),
d AS (SELECT doc_id, sha256(text) AS grp, lang, source FROM documents),
g AS (SELECT grp, min(lang) AS label, arg_min(source, doc_id) AS stratum, count(*) AS n_items FROM d GROUP BY grp),
h AS (SELECT *, sha256(concat_ws(chr(31), '7', label, stratum, grp)) AS h FROM g WHERE label IN ('en', 'fr', 'de')),
t AS (SELECT *, row_number() OVER (PARTITION BY label, stratum ORDER BY h, grp) AS turn, count(*) OVER (PARTITION BY label, stratum) AS size, first_value(grp) OVER (PARTITION BY label, stratum ORDER BY h, grp) AS head FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY turn, size DESC, head) - 1 AS position FROM t),
s AS (SELECT o.*, deal.partition FROM o JOIN deal ON deal.i = CASE WHEN position < 200 THEN position ELSE 100 + (position - 200) % 100 END)
"""


def _split(spark: SparkSession, d: str, names: list[str], ratios: list[float]) -> DataFrame:
    g = grouped(spark, d).where(F.col("label").isin(*CLASSES))
    return splits.assign(g, "grp", "label", "stratum", names, ratios)


@query(f"WITH {_split_sql(NAMES, RATIOS)} SELECT grp, label, stratum, n_items, position, partition FROM s")
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, NAMES, RATIOS).select("grp", "label", "stratum", "n_items", F.col("position").cast("long").alias("position"), "partition")


@query(f"WITH {_split_sql(FOLDS, [0.2] * 5)} SELECT grp, label, CASE WHEN partition = 'fold_2' THEN 'val' ELSE 'train' END AS partition FROM s")
def kfold_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.fold_view(_split(spark, d, FOLDS, [0.2] * 5), 2).select("grp", "label", "partition")


@query(f"""
WITH {_split_sql(NAMES, RATIOS)}
SELECT partition, label, stratum, count(*) AS n_groups, CAST(sum(n_items) AS BIGINT) AS n_items FROM s GROUP BY GROUPING SETS ((partition), (partition, label), (partition, stratum))
""")
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    items = _split(spark, d, NAMES, RATIOS).select("grp", "label", "stratum", "partition", F.explode(F.sequence(F.lit(1), F.col("n_items").cast("int"))).alias("k"))
    return splits.summary(items, "partition", "grp", "label", "stratum")


ASSIGNED = "a AS (SELECT doc_id, source, sha256(text) AS h, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS partition FROM documents)"


@query(f"""
WITH {ASSIGNED}
SELECT 'h' AS kind, count(*) AS n_keys FROM (SELECT h FROM a GROUP BY h HAVING count(DISTINCT partition) > 1)
UNION ALL SELECT 'source', count(*) FROM (SELECT source FROM a GROUP BY source HAVING count(DISTINCT partition) > 1)
UNION ALL SELECT 'doc_id', count(*) FROM (SELECT doc_id FROM a GROUP BY doc_id HAVING count(DISTINCT partition) > 1)
""")
def verify_partitions(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 10
    a = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"), F.when(m < 7, "train").when(m < 9, "val").otherwise("test").alias("partition"))
    return splits.overlaps(a, "partition", ["h", "source", "doc_id"])


@query("""
WITH d AS (SELECT doc_id FROM documents), a AS (SELECT doc_id FROM documents WHERE doc_id % 10 < 8 UNION ALL SELECT -1), e AS (SELECT doc_id FROM documents WHERE doc_id % 10 IN (7, 8))
SELECT (SELECT count(*) FROM (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM e)) AS n_both, (SELECT count(*) FROM (SELECT doc_id FROM d EXCEPT SELECT doc_id FROM a EXCEPT SELECT doc_id FROM e)) AS n_unaccounted,
  (SELECT count(*) FROM ((SELECT doc_id FROM a UNION SELECT doc_id FROM e) EXCEPT SELECT doc_id FROM d)) AS n_unknown
""")
def manifest_accounting(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    assigned = docs.where("doc_id % 10 < 8").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("doc_id")))
    return splits.accounting(docs, "doc_id", assigned, docs.where("doc_id % 10 IN (7, 8)"))


@query("SELECT source, CASE WHEN count(DISTINCT s) = 1 THEN min(s) END AS split, count(DISTINCT s) AS n_splits FROM (SELECT source, CASE WHEN doc_id % 40 = 3 THEN 'test' ELSE 'train' END AS s FROM documents) GROUP BY source")
def adopt_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", F.when(F.col("doc_id") % 40 == 3, "test").otherwise("train").alias("s"))
    return splits.adopt(docs, "source", "s")


@query(f"""
WITH RECURSIVE {SIMHASH},
e AS (SELECT item_a AS a, item_b AS b FROM p UNION SELECT item_b, item_a FROM p),
r(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
mem AS (SELECT node AS g, min(root) AS c FROM r GROUP BY node),
x AS (SELECT c.item AS g, CASE WHEN c.item % 10 < 7 THEN 'train' WHEN c.item % 10 < 9 THEN 'val' ELSE 'test' END AS was, d.lang AS l, mem.c FROM c JOIN documents d ON d.doc_id = c.item LEFT JOIN mem ON mem.g = c.item),
n AS (SELECT c, was, count(*) AS n FROM x WHERE c IS NOT NULL GROUP BY c, was),
h AS (SELECT c, was AS home FROM n QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, list_position(['train', 'val', 'test'], was)) = 1),
y AS (SELECT x.g, x.was, x.l, x.c, coalesce(h.home, x.was) AS now FROM x LEFT JOIN h USING (c)),
d AS (SELECT l, q, sum(v) AS d FROM (SELECT l, now AS q, 1 AS v FROM y UNION ALL SELECT l, was, -1 FROM y) GROUP BY l, q HAVING sum(v) <> 0),
slot AS (SELECT *, sum(abs(d)) OVER (PARTITION BY l, d > 0 ORDER BY q) AS upto FROM d),
f AS (SELECT y.g, y.l, s.upto - s.d AS before, s.d AS d, row_number() OVER (PARTITION BY y.l, y.now ORDER BY sha256('7' || chr(31) || 'rebalance' || chr(31) || y.g), y.g) AS k FROM y JOIN slot s ON s.l = y.l AND s.q = y.now AND s.d > 0 WHERE y.c IS NULL),
z AS (SELECT f.g, s.q AS dest FROM f JOIN slot s ON s.l = f.l AND s.d < 0 AND f.before + f.k > s.upto + s.d AND f.before + f.k <= s.upto WHERE f.k <= f.d)
SELECT y.g AS item, y.was, coalesce(z.dest, y.now) AS partition FROM y LEFT JOIN z USING (g)
""")
def component_regroup(spark: SparkSession, d: str) -> DataFrame:
    """Representatives of near-duplicate patterns, split by id, moved so that no component is divided and no language's share of a partition changes."""
    m = F.col("item") % 10
    langs = table(spark, d, "documents").select(F.col("doc_id").alias("item"), "lang")
    hashed = hashes(spark, d)
    start = representatives(hashed).select("item", F.when(m < 7, "train").when(m < 9, "val").otherwise("test").alias("partition")).join(langs, "item")
    members = near_components(hashed).select(F.col("node").alias("item"), "component")
    return splits.regroup(start, members, "item", "component", "partition", "lang")
