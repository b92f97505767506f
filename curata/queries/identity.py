"""Documents as records: id doc_id, content hash sha256(text), group source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.operators import identity as I  # noqa: E741
from curata.plans.storage import materialize
from curata.queries._registry import query, table


def hashed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("h"))


@query("""
WITH d AS (SELECT doc_id, source, sha256(text) AS h FROM documents),
f AS (SELECT h, arg_min(source, doc_id) AS g0, min(doc_id) AS i0 FROM d GROUP BY h)
SELECT CASE WHEN source <> g0 THEN 'R4' ELSE 'E5' END AS rule, CASE WHEN source <> g0 THEN 'error' ELSE 'warning' END AS severity, doc_id AS record_index,
  doc_id AS item, source AS grp, i0 AS first_item, g0 AS first_grp
FROM d JOIN f USING (h) WHERE doc_id > i0
""")
def dup_findings(spark: SparkSession, d: str) -> DataFrame:
    found = I.duplicate_findings(hashed(spark, d).withColumn("i", F.col("doc_id")), "i", "doc_id", "source", "h")
    return found.select("rule", "severity", "record_index", "item", "grp", "first_item", "first_grp")


@query("""
WITH r AS (SELECT doc_id * 2 + k AS i, doc_id FROM documents, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR doc_id % 10 = 0), f AS (SELECT doc_id, min(i) AS i0 FROM r GROUP BY doc_id)
SELECT 'R1' AS rule, i AS record_index, doc_id AS item, i0 AS first_index FROM r JOIN f USING (doc_id) WHERE i > i0
""")
def dup_item_id(spark: SparkSession, d: str) -> DataFrame:
    """Ids are unique in the table, so each tenth row is recorded a second time."""
    docs = table(spark, d, "documents").select("doc_id")
    rows = docs.select("doc_id", F.explode(F.when(F.col("doc_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k"))
    out = I.repeated_ids(rows.select("doc_id", (F.col("doc_id") * 2 + F.col("k")).alias("i")), "i", "doc_id")
    return out.select("rule", "record_index", "item", "first_index")


@query("""
WITH r AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN 'test' WHEN doc_id % 7 = 1 THEN 'val' ELSE 'train' END AS split FROM documents),
l AS (SELECT source, split, max(doc_id) AS i FROM r GROUP BY source, split)
SELECT 'R3' AS rule, source AS grp, count(*) AS n_splits, min(i) AS record_index, string_agg(split, ',' ORDER BY split) AS splits FROM l GROUP BY source HAVING count(*) > 1
""")
def group_split_conflict(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    m = F.col("doc_id") % 7
    rows = docs.select("doc_id", "source", F.when(m == 0, "test").when(m == 1, "val").otherwise("train").alias("split"))
    return I.split_conflicts(rows, "doc_id", "source", "split")


FINGERPRINT = """
WITH r AS (SELECT doc_id AS id, sha256({row}) AS h, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 6) AS b FROM documents),
s AS (SELECT b, sha256(string_agg(h, '' ORDER BY id, h)) AS h, count(*) AS n FROM r GROUP BY b),
t AS (SELECT substr(b, 1, 3) AS b, sha256(string_agg(h, '' ORDER BY b)) AS h, sum(n) AS n FROM s GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, sha256('{header}' || string_agg(h, '' ORDER BY b)) AS fingerprint FROM t
"""


@query(FINGERPRINT.format(row="concat_ws(chr(31), CAST(doc_id AS VARCHAR), lang, source, sha256(text))", header="dataset"))
def dataset_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    row = F.concat_ws("\x1f", F.col("doc_id").cast("string"), "lang", "source", "h")
    return I.fingerprint(hashed(spark, d), "doc_id", row, "dataset")


@query(FINGERPRINT.format(row="concat_ws(chr(31), source, CAST(doc_id AS VARCHAR), sha256(text))", header="images"))
def image_set_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    row = F.concat_ws("\x1f", "source", F.col("doc_id").cast("string"), "h")
    return I.fingerprint(hashed(spark, d), "doc_id", row, "images")


BITS = 64


def simhash(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, bits of the documents that have words."""
    return I.simhash(table(spark, d, "documents"), ["doc_id"], "text").where("bits IS NOT NULL")


SIMHASH = """
t AS (SELECT sha256(text) AS h, any_value(text) AS text, min(doc_id) AS item FROM documents GROUP BY 1),
w AS (SELECT h, [x FOR x IN string_split(text, ' ') IF x <> ''] AS w FROM t),
s AS (SELECT DISTINCT h, array_to_string(w[i:i + 2], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i) WHERE len(w) > 0),
m AS (SELECT h, CAST('0x' || substr(md5(s), 1, 8) AS BIGINT) AS a, CAST('0x' || substr(md5(s), 9, 8) AS BIGINT) AS b FROM s),
v AS (SELECT h, k, sum(((a >> k) & 1) * 2 - 1) AS va, sum(((b >> k) & 1) * 2 - 1) AS vb FROM m, (SELECT unnest(range(32)) AS k) GROUP BY h, k),
g AS (
  SELECT h, CAST(sum(CASE WHEN va > 0 THEN CAST(1 AS BIGINT) << k ELSE 0 END) AS BIGINT) AS hi, CAST(sum(CASE WHEN vb > 0 THEN CAST(1 AS BIGINT) << k ELSE 0 END) AS BIGINT) AS lo FROM v GROUP BY h
),
c AS (SELECT hi, lo, min(item) AS item FROM g JOIN t USING (h) GROUP BY hi, lo),
p AS (
  SELECT least(x.item, y.item) AS item_a, greatest(x.item, y.item) AS item_b, CAST(bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) AS INT) AS distance
  FROM c x JOIN c y ON x.item < y.item WHERE bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= 6
)
"""


def hashes(spark: SparkSession, d: str) -> DataFrame:
    """simhash, written: what follows reads it several times."""
    return materialize(simhash(spark, d), "simhash")


def representatives(hashed: DataFrame) -> DataFrame:
    """bits, item: the smallest id of each pattern; copies and equal patterns are one."""
    return hashed.groupBy("bits").agg(F.min("doc_id").alias("item"))


def near(hashed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as groups of their own."""
    return I.near_links(hashed.withColumn("own", F.col("doc_id")), "doc_id", "own", "bits", 6)


def near_components(hashed: DataFrame) -> DataFrame:
    return I.components(near(hashed)[1], "item_a", "item_b")


@query(f"WITH {SIMHASH} SELECT item_a, item_b, distance FROM p")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of pattern representatives at most six bits apart; membership in a pattern is near_dup_members."""
    return near(hashes(spark, d))[1]


@query(f"WITH {SIMHASH} SELECT d.doc_id, c.item AS representative FROM documents d JOIN g ON sha256(d.text) = g.h JOIN c USING (hi, lo)")
def near_dup_members(spark: SparkSession, d: str) -> DataFrame:
    return near(hashes(spark, d))[0].select("doc_id", "representative")


@query(f"""
WITH RECURSIVE {SIMHASH},
e AS (SELECT item_a AS a, item_b AS b FROM p UNION SELECT item_b, item_a FROM p),
r(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT node, min(root) AS component FROM r GROUP BY node
""")
def near_dup_components(spark: SparkSession, d: str) -> DataFrame:
    return near_components(hashes(spark, d))


@query("SELECT b.item_id, count(*) AS n_docs, min(d.doc_id) AS first_doc FROM benchmark b JOIN documents d ON sha256(d.text) = sha256(b.text) GROUP BY b.item_id")
def benchmark_exact_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are a benchmark text whole: identity by digest."""
    b = table(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("h"))
    return hashed(spark, d).join(b, "h").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("""
WITH w AS (SELECT DISTINCT item_id, array_to_string(string_split(text, ' ')[i:i + 7], ' ') AS s FROM (SELECT item_id, text, unnest(range(1, len(string_split(text, ' ')) - 6)) AS i FROM benchmark)),
x AS (SELECT DISTINCT doc_id, array_to_string(string_split(text, ' ')[i:i + 7], ' ') AS s FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, ' ')) - 6)) AS i FROM documents))
SELECT item_id, doc_id, count(*) AS n_shared FROM w JOIN x USING (s) GROUP BY item_id, doc_id
""")
def benchmark_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items and documents that share passages of eight words, whichever text is longer."""
    return I.shared_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id")
