"""Intervals from orders and line items, claims and licences from small tables, boxes and codes from line items and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import scalars as S
from curata.operators import dating
from curata.operators import evidence as E
from curata.queries._registry import query, table


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of an order: each line bounds it by years made of quantity and part, some open at one side; tiers by line number."""
    q, p = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 40).cast("int")
    start = F.when(F.col("l_linenumber") % 5 == 0, None).otherwise(p - 60)
    end = F.when(F.col("l_linenumber") % 7 == 3, None).otherwise(p + q)
    return table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).cast("int").alias("tier"), F.col("l_linenumber").cast("int").alias("item"), start.alias("start"), end.alias("end"))


IV = """
i AS (
  SELECT l_orderkey, CAST(l_linenumber % 3 AS INT) AS tier, CAST(l_linenumber AS INT) AS item, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE CAST(l_partkey % 40 AS INT) - 60 END AS s,
    CASE WHEN l_linenumber % 7 = 3 THEN NULL ELSE CAST(l_partkey % 40 AS INT) + CAST(l_quantity AS INT) END AS e FROM lineitem
)
"""


@query(f"""
WITH RECURSIVE {IV},
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY tier, item) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM i WHERE s IS NOT NULL OR e IS NOT NULL),
f(l_orderkey, k, n, s, e, used, conflicts) AS (
  SELECT l_orderkey, k, n, s, e, CAST(item AS VARCHAR), '' FROM n WHERE k = 1
  UNION ALL
  SELECT n.l_orderkey, n.k, n.n, CASE WHEN coalesce(greatest(f.s, n.s) > least(f.e, n.e), false) THEN f.s ELSE greatest(f.s, n.s) END, CASE WHEN coalesce(greatest(f.s, n.s) > least(f.e, n.e), false) THEN f.e ELSE least(f.e, n.e) END,
    CASE WHEN coalesce(greatest(f.s, n.s) > least(f.e, n.e), false) THEN f.used ELSE f.used || ',' || n.item END,
    CASE WHEN coalesce(greatest(f.s, n.s) > least(f.e, n.e), false) THEN CASE WHEN f.conflicts = '' THEN CAST(n.item AS VARCHAR) ELSE f.conflicts || ',' || n.item END ELSE f.conflicts END
  FROM f JOIN n ON n.l_orderkey = f.l_orderkey AND n.k = f.k + 1
)
SELECT o.l_orderkey, CASE WHEN f.used IS NULL THEN 'insufficient_evidence' ELSE 'estimated' END AS state, f.s AS start, f.e AS "end", coalesce(f.used, '') AS used, coalesce(f.conflicts, '') AS conflicts
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN (SELECT * FROM f WHERE k = n) f USING (l_orderkey)
""")
def interval_fold(spark: SparkSession, d: str) -> DataFrame:
    return dating.estimate(intervals(spark, d), "l_orderkey", "tier", "item", "start", "end").drop("display")


@query(f"WITH {IV} SELECT l_orderkey, CASE WHEN NOT bool_or(s IS NULL) THEN min(s) END AS start, CASE WHEN NOT bool_or(e IS NULL) THEN max(e) END AS \"end\" FROM i GROUP BY l_orderkey")
def interval_hull(spark: SparkSession, d: str) -> DataFrame:
    return intervals(spark, d).groupBy("l_orderkey").agg(S.enclosing_range(F.col("start"), F.col("end")).alias("h")).select("l_orderkey", "h.*")


@query(f"""
WITH {IV}
SELECT a.l_orderkey, a.item, CASE WHEN a.s IS NULL AND a.e IS NULL AND b.s IS NULL AND b.e IS NULL THEN 'none' WHEN (a.s IS NULL AND a.e IS NULL) OR (b.s IS NULL AND b.e IS NULL) THEN 'one_sided' WHEN a.s IS NULL OR a.e IS NULL OR b.s IS NULL OR b.e IS NULL THEN 'open' WHEN a.s = b.s AND a.e = b.e THEN 'identical' WHEN a.s > b.e OR b.s > a.e THEN 'disjoint' ELSE 'overlapping' END AS relation
FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.item + 1 = b.item
""")
def interval_relation(spark: SparkSession, d: str) -> DataFrame:
    """Each line's interval against the next line's, by line number."""
    i = intervals(spark, d)
    a = i.select("l_orderkey", "item", F.col("start").alias("s1"), F.col("end").alias("e1"))
    b = i.select("l_orderkey", (F.col("item") - 1).alias("item"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    return a.join(b, ["l_orderkey", "item"]).select("l_orderkey", "item", S.range_relation(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")).alias("relation"))


@query("""
WITH y AS (SELECT o_orderkey, CAST(o_orderkey % 601 - 300 AS INT) AS a, CAST(o_custkey % 211 AS INT) + 1 + CAST(o_orderkey % 601 - 300 AS INT) AS b FROM orders)
SELECT o_orderkey, b - a - CASE WHEN a < 0 AND b > 0 THEN 1 ELSE 0 END AS years, CASE WHEN a < 0 THEN (-a) || ' BCE' ELSE a || ' CE' END AS start_year,
  ((abs(a) - 1) // 100 + 1) || CASE WHEN ((abs(a) - 1) // 100 + 1) % 100 BETWEEN 10 AND 20 THEN 'th' WHEN ((abs(a) - 1) // 100 + 1) % 10 = 1 THEN 'st' WHEN ((abs(a) - 1) // 100 + 1) % 10 = 2 THEN 'nd' WHEN ((abs(a) - 1) // 100 + 1) % 10 = 3 THEN 'rd' ELSE 'th' END
  || ' century ' || CASE WHEN a < 0 THEN 'BCE' ELSE 'CE' END AS century
FROM y WHERE a <> 0 AND b <> 0
""")
def years_between(spark: SparkSession, d: str) -> DataFrame:
    a = (F.col("o_orderkey") % 601 - 300).cast("int")
    y = table(spark, d, "orders").select("o_orderkey", a.alias("a"), ((F.col("o_custkey") % 211).cast("int") + 1 + a).alias("b")).where(S.valid_year(F.col("a")) & S.valid_year(F.col("b")))
    return y.select("o_orderkey", S.year_span(F.col("a"), F.col("b")).alias("years"), S.year_label(F.col("a")).alias("start_year"), S.century_label(F.col("a")).alias("century"))


PERIODS = [("early", -300, -100), ("middle", -150, 100), ("late", 50, 300), ("long", -300, 300)]


@query(f"""
WITH y AS (SELECT o_orderkey, CAST(o_orderkey % 601 - 300 AS INT) AS a, CAST(o_orderkey % 601 - 300 AS INT) + CAST(o_custkey % 60 AS INT) AS b FROM orders), p(period, s, e) AS (VALUES {", ".join(map(str, PERIODS))})
SELECT o_orderkey, period, CASE WHEN a >= s AND b <= e THEN 'within' ELSE 'overlaps' END AS relation FROM y JOIN p ON a <= e AND b >= s
""")
def period_overlap(spark: SparkSession, d: str) -> DataFrame:
    a = (F.col("o_orderkey") % 601 - 300).cast("int")
    y = table(spark, d, "orders").select("o_orderkey", a.alias("a"), (a + (F.col("o_custkey") % 60).cast("int")).alias("b"))
    periods = spark.createDataFrame(PERIODS, "period string, p_start int, p_end int")
    return E.period_overlap(y, "a", "b", periods).select("o_orderkey", "period", "relation")


@query("""
WITH c AS (SELECT s_suppkey AS claim_id, s_name AS statement, s_nationkey, (s_nationkey + 1) % 25 AS other FROM supplier),
x AS (SELECT claim_id, statement, s_nationkey AS ref_id FROM c UNION ALL SELECT claim_id, statement, other FROM c),
h AS (SELECT s_suppkey AS claim_id, s_name AS claim, s_nationkey AS ref_id, v, CASE (s_suppkey + v) % 3 WHEN 0 THEN 'verified_against_source' WHEN 1 THEN 'discrepancy_found' ELSE 'could_not_access' END AS status FROM supplier, (SELECT unnest([1, 2, 3]) AS v) WHERE s_suppkey % 4 <> 0 AND v <= 1 + s_suppkey % 3),
r AS (SELECT claim_id, claim, ref_id, arg_max(status, v) AS status FROM h GROUP BY ALL)
SELECT x.claim_id, x.ref_id, coalesce(a.status, b.status, 'unverified') AS status
FROM x LEFT JOIN r a ON a.claim_id = x.claim_id AND a.ref_id = x.ref_id AND a.claim_id % 2 = 0 LEFT JOIN r b ON lower(b.claim) = lower(x.statement) AND b.ref_id = x.ref_id AND b.claim_id % 2 = 1
""")
def claim_status(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as claims that cite two nations; records name a claim by its id, or, where that is odd, by its text."""
    s = table(spark, d, "supplier")
    claims = s.select(F.col("s_suppkey").alias("claim_id"), F.col("s_name").alias("statement"), F.array(F.col("s_nationkey"), (F.col("s_nationkey") + 1) % 25).alias("ref_ids"))
    return E.claim_report(claims, claim_history(s), "v").select("claim_id", "ref_id", "status")


def claim_records(s: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    status = F.when(k % 3 == 0, "verified_against_source").when(k % 3 == 1, "discrepancy_found").otherwise("could_not_access")
    return s.where(k % 4 != 0).select(F.when(k % 2 == 0, k).alias("claim_id"), F.col("s_name").alias("claim"), F.col("s_nationkey").alias("ref_id"), status.alias("status"))


def claim_history(s: DataFrame) -> DataFrame:
    """One to three records of a claim, of which the one of the highest v is the latest; a quarter of the claims has none."""
    k, v = F.col("s_suppkey"), F.col("v")
    status = F.when((k + v) % 3 == 0, "verified_against_source").when((k + v) % 3 == 1, "discrepancy_found").otherwise("could_not_access")
    return s.where(k % 4 != 0).withColumn("v", F.explode(F.sequence(F.lit(1), (1 + k % 3).cast("int")))).select("v", F.when(k % 2 == 0, k).alias("claim_id"), F.col("s_name").alias("claim"), F.col("s_nationkey").alias("ref_id"), status.alias("status"))


@query("""
WITH g AS (SELECT s_nationkey AS ref_id, bool_or(s_suppkey % 3 = 1) AS d, bool_or(s_suppkey % 3 = 0) AS v FROM supplier WHERE s_suppkey % 4 <> 0 GROUP BY 1),
n AS (SELECT n_nationkey AS ref_id, CASE WHEN n_nationkey % 2 = 0 THEN 'verified_against_source' ELSE 'located' END AS kb FROM nation)
SELECT ref_id, CASE WHEN coalesce(d, false) THEN 'discrepancy_found' WHEN coalesce(v, false) THEN 'verified_against_source' WHEN kb = 'verified_against_source' THEN 'unverified' ELSE kb END AS effective FROM n LEFT JOIN g USING (ref_id)
""")
def reference_status(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "nation").select(F.col("n_nationkey").alias("ref_id"), F.when(F.col("n_nationkey") % 2 == 0, "verified_against_source").otherwise("located").alias("kb_status"))
    return E.reference_status(refs, claim_records(table(spark, d, "supplier")))


LICENSES = ["CC BY 4.0", "CC BY-SA 3.0", "cc-by-nc 4.0", "CC BY-NC-ND 2.0", "CC0", "Public domain", "GODL-India", "Copyrighted", "CC BY 1.0", ""]
DECISIONS = [("CC-BY-4.0", "allowed"), ("CC-BY-SA-3.0", "allowed"), ("CC-BY-NC-4.0", "non_commercial"), ("CC-BY-NC-ND-2.0", "no_derivatives"), ("CC0-1.0", "allowed"), ("public_domain", "public_domain"), ("GODL-India", "godl"), ("unknown", "unknown"), ("CC-BY-1.0", "not_listed"), ("unknown", "unknown")]


@query(f"""
WITH l(k, id, why) AS (VALUES {", ".join(str((i, *x)) for i, x in enumerate(DECISIONS))})
SELECT page_id, id, why = 'allowed' AS accepted, why FROM pages JOIN l ON page_id % 10 = k
""")
def license_decision(spark: SparkSession, d: str) -> DataFrame:
    verbatim = F.element_at(F.array(*map(F.lit, LICENSES)), (F.col("page_id") % 10 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", E.license_decision(verbatim).alias("x")).select("page_id", "x.*")


@query("""
WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN 'missing' WHEN url NOT LIKE 'https://%' THEN 'not_https' WHEN host = 'example.com' OR host LIKE '%.example.com' THEN 'blocked' END AS problem FROM u
""")
def page_policy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", E.url_problems(F.col("url"), ["example.com"]).alias("problem"))


@query(f"""
WITH l(k, why) AS (VALUES {", ".join(str((i, x[1])) for i, x in enumerate(DECISIONS))}),
u AS (SELECT page_id AS i, coalesce(url, '') AS url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, length(html) AS size, why FROM pages JOIN l ON page_id % 10 = k),
b AS (SELECT *, url = '' OR url NOT LIKE 'https://%' OR host = 'example.com' OR host LIKE '%.example.com' AS bad FROM u),
r AS (
  SELECT i, array_to_string([x FOR x IN [
    CASE WHEN i % 9 = 0 THEN 'A1' END, CASE WHEN bad THEN 'A2:source_url' END, CASE WHEN bad THEN 'A2:image_url' END, CASE WHEN why <> 'allowed' THEN 'A3' END, CASE WHEN i % 4 = 0 THEN 'A4' END, CASE WHEN i % 31 = 0 THEN 'A5:restrictions' END,
    CASE WHEN i % 17 = 0 THEN 'A5:flagged' END, CASE WHEN i % 23 = 0 THEN 'A6:artist' END, CASE WHEN i % 6 = 0 THEN 'A7' END, CASE WHEN NOT coalesce(size BETWEEN 1 AND 100000, false) THEN 'A8' END, CASE WHEN i IN (7, 8) THEN 'A9' END
  ] IF x IS NOT NULL], ',') AS reasons FROM b
)
SELECT i AS page_id, reasons = '' AS accepted, reasons FROM r
""")
def acquisition_policy(spark: SparkSession, d: str) -> DataFrame:
    """Pages as candidates under all rules A1 to A9."""
    i = F.col("page_id")
    c = table(spark, d, "pages").select(
        "page_id", F.when(i % 9 == 0, "elsewhere").otherwise("commons").alias("source"), F.col("url").alias("source_url"), F.col("url").alias("image_url"), F.element_at(F.array(*map(F.lit, LICENSES)), (i % 10 + 1).cast("int")).alias("license"),
        F.when(i % 4 == 0, "Museum").otherwise("Own work").alias("credit"), F.when(i % 31 == 0, "trademark").otherwise("").alias("restrictions"), F.array(F.lit("Pottery"), F.when(i % 17 == 0, "Copyright violations").otherwise("Sherds")).alias("categories"),
        F.concat(F.lit("t"), i.cast("string")).alias("title"), i.cast("string").alias("record_id"), F.when(i % 23 == 0, "").otherwise("a").alias("artist"), F.lit("c").alias("checksum"), F.when(i % 6 == 0, "image/gif").otherwise("image/jpeg").alias("mime"), F.length("html").alias("size_bytes"),
    )
    out = spark.createDataFrame([("t7",), ("t8",)], "title string")
    done = E.policy(c, ["commons"], ["image/jpeg", "image/png"], ["own work"], ["copyright violation"], 100_000, ["example.com"], out)
    return done.select("page_id", "accepted", F.array_join("reasons", ",").alias("reasons"))


@query("""
WITH d AS (SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL OR text = '') AS n_empty, count(DISTINCT doc_id) AS n_ids, count(DISTINCT lang) AS n_langs FROM documents), l AS (SELECT count(*) AS n_labels FROM labels)
SELECT CAST(g AS INT) AS gate_no, gate, result FROM (
  SELECT 1 AS g, 'records_present' AS gate, CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM d UNION ALL SELECT 2, 'ids_unique', CASE WHEN n_ids = n THEN 'PASS' ELSE 'FAIL' END FROM d
  UNION ALL SELECT 3, 'texts_present', CASE WHEN n_empty = 0 THEN 'PASS' ELSE 'FAIL' END FROM d UNION ALL SELECT 4, 'classes_present', CASE WHEN n_langs >= 4 THEN 'PASS' ELSE 'FAIL' END FROM d
  UNION ALL SELECT 5, 'all_labelled', CASE WHEN n_labels >= n THEN 'PASS' ELSE 'FAIL' END FROM d, l UNION ALL SELECT 6, 'files_match', 'NOT_EVALUATED')
""")
def gates_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("n_empty"), F.count_distinct("doc_id").alias("n_ids"), F.count_distinct("lang").alias("n_langs"))
    row = docs.join(table(spark, d, "labels").agg(F.count(F.lit(1)).alias("n_labels")), F.lit(True))
    yes = F.lit(True)
    return E.gates(row, [
        ("records_present", yes, F.col("n") > 0), ("ids_unique", yes, F.col("n_ids") == F.col("n")), ("texts_present", yes, F.col("n_empty") == 0), ("classes_present", yes, F.col("n_langs") >= 4),
        ("all_labelled", yes, F.col("n_labels") >= F.col("n")), ("files_match", F.lit(False), yes),
    ])


@query("""
WITH c AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(DISTINCT doc_id) FROM documents) AS n_ids, (SELECT count(*) FROM documents WHERE coalesce(text, '') = '') AS n_empty, (SELECT count(DISTINCT lang) FROM documents) AS n_langs, (SELECT count(*) FROM labels) AS n_labels),
r AS (SELECT n > 0 AS a, n_ids = n AS b, n_empty = 0 AS c, n_langs >= 4 AS d, n_labels >= n AS e FROM c)
SELECT CASE WHEN NOT a THEN 'records_present' WHEN NOT b THEN 'ids_unique' WHEN NOT c THEN 'texts_present' WHEN NOT d THEN 'classes_present' WHEN NOT e THEN 'all_labelled' ELSE 'files_match' END AS stage,
  CAST(a AS BIGINT) + CAST(b AS BIGINT) + CAST(c AS BIGINT) + CAST(d AS BIGINT) + CAST(e AS BIGINT) AS n_passed, CAST(6 AS BIGINT) AS n_stages FROM r
""")
def workflow_stage(spark: SparkSession, d: str) -> DataFrame:
    return E.current_stage(gates_report(spark, d))


CODES = {"G0": "N", "G1": "N", "G2": "V", "G3": "#", "G4": "-", "G5": "N", "G6": "V"}
READINGS = {c: f"{c.lower()}a" for c in CODES}


def code_rows(spark: SparkSession, d: str) -> DataFrame:
    """Codes from the digits of a part's key and size, G7 being no code of the language."""
    n = F.col("p_partkey") * 97 + F.col("p_size") * 13
    digit = lambda k: F.floor(n / k) % 8
    whole = F.array(*[F.concat(F.lit("G"), F.when(digit(8**i) == 7, F.when(n % 11 == 0, 7).otherwise(2)).otherwise(digit(8**i)).cast("string")) for i in range(5)])
    base = F.when(F.col("p_partkey") % 3 == 0, F.array(*map(F.lit, ["G0", "G1", "G2"]))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", F.concat(base, F.slice(whole, F.lit(1), (F.col("p_size") % 6).cast("int"))).alias("codes"))


@query("""
WITH x AS (SELECT p_partkey, p_size, p_partkey * 97 + p_size * 13 AS n FROM part),
g AS (SELECT p_partkey, p_size, [CASE WHEN (n // k) % 8 = 7 THEN CASE WHEN n % 11 = 0 THEN 7 ELSE 2 END ELSE (n // k) % 8 END FOR k IN [1, 8, 64, 512, 4096]] AS dg FROM x),
c AS (SELECT p_partkey, list_concat(CASE WHEN p_partkey % 3 = 0 THEN [0, 1, 2] ELSE [] END, dg[1:(p_size % 6)]) AS codes FROM g),
s AS (SELECT p_partkey, codes, array_to_string([CASE k WHEN 0 THEN 'N' WHEN 1 THEN 'N' WHEN 2 THEN 'V' WHEN 3 THEN '#' WHEN 4 THEN '-' WHEN 5 THEN 'N' WHEN 6 THEN 'V' ELSE '?' END FOR k IN codes], '') AS s FROM c),
p AS (SELECT *, CASE WHEN s LIKE '%?%' THEN '' ELSE regexp_extract(s, '^((?:#?N#?NV-?)+)', 1) END AS pre FROM s)
SELECT p_partkey, CASE WHEN len(codes) = 0 THEN 'insufficient_evidence' WHEN s LIKE '%?%' THEN 'unknown_glyph' WHEN pre = '' THEN 'invalid_sequence' WHEN pre = s THEN 'translated' ELSE 'partial' END AS status,
  CAST(length(pre) - length(replace(pre, 'V', '')) AS INT) AS n_clauses, CAST(length(pre) AS INT) AS n_translated,
  array_to_string([CASE WHEN k = 7 THEN '[?]' ELSE 'g' || k || 'a' END FOR k IN codes], ' ') AS reading
FROM p
""")
def lang_decode(spark: SparkSession, d: str) -> DataFrame:
    rows = code_rows(spark, d).select("p_partkey", E.decode(F.col("codes"), CODES).alias("x"), E.transliterate(F.col("codes"), READINGS).alias("reading"))
    return rows.select("p_partkey", "x.*", "reading")


def boxes(spark: SparkSession, d: str, shift: int) -> DataFrame:
    """image: an order; a box for each line, from its part and quantity; the predictions are the boxes shifted."""
    x, y = (F.col("l_partkey") * 7 % 50).cast("double"), (F.col("l_suppkey") * 3 % 50).cast("double")
    moved = (F.col("l_linenumber") % 4 * shift).cast("double")
    box = F.struct((x + moved).alias("x"), y.alias("y"), (F.col("l_quantity") + 5).alias("w"), F.lit(20.0).alias("h"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").cast("int").alias("i"), box.alias("box"))


BOXES = """
t AS (SELECT l_orderkey AS image, CAST(l_linenumber AS INT) AS i, CAST(l_partkey * 7 % 50 AS DOUBLE) AS x, CAST(l_suppkey * 3 % 50 AS DOUBLE) AS y, l_quantity + 5 AS w, CAST(l_linenumber % 4 * 3 AS DOUBLE) AS m FROM lineitem),
o AS (SELECT a.image, a.i, greatest(0, least(a.x + a.m + a.w, b.x + b.w) - greatest(a.x + a.m, b.x)) * greatest(0, least(a.y, b.y) + 20 - greatest(a.y, b.y)) AS inter, a.w * 20 + b.w * 20 AS area FROM t a JOIN t b USING (image))
"""


GREEDY = """
c AS (SELECT a.image, a.i AS pi, b.i AS ti, o.inter / (o.area - o.inter) AS iou, sqrt(pow(a.x + a.m + a.w / 2 - b.x - b.w / 2, 2) + pow(a.y - b.y, 2)) AS dist, greatest(b.w, 20) / 2 AS reach
  FROM t a JOIN t b USING (image), LATERAL (SELECT greatest(0, least(a.x + a.m + a.w, b.x + b.w) - greatest(a.x + a.m, b.x)) * greatest(0, least(a.y, b.y) + 20 - greatest(a.y, b.y)) AS inter, a.w * 20 + b.w * 20 AS area) o),
k AS (SELECT image, pi, ti, iou AS v, row_number() OVER (PARTITION BY image ORDER BY iou DESC, pi DESC, ti DESC) AS k FROM c WHERE iou >= 0.5),
g(image, k, ps, ts, pi, ti, v, taken) AS (
  SELECT image, k, [pi], [ti], pi, ti, v, true FROM k WHERE k = 1
  UNION ALL
  SELECT k.image, k.k, CASE WHEN list_contains(g.ps, k.pi) OR list_contains(g.ts, k.ti) THEN g.ps ELSE list_append(g.ps, k.pi) END, CASE WHEN list_contains(g.ps, k.pi) OR list_contains(g.ts, k.ti) THEN g.ts ELSE list_append(g.ts, k.ti) END,
    k.pi, k.ti, k.v, NOT (list_contains(g.ps, k.pi) OR list_contains(g.ts, k.ti)) FROM g JOIN k ON k.image = g.image AND k.k = g.k + 1
)
"""
CENTRE = """
c AS (SELECT a.image, a.i AS pi, b.i AS ti, o.inter / (o.area - o.inter) AS iou, sqrt(pow(a.x + a.m + a.w / 2 - b.x - b.w / 2, 2) + pow(a.y - b.y, 2)) AS dist, greatest(b.w, 20) / 2 AS reach
  FROM t a JOIN t b USING (image), LATERAL (SELECT greatest(0, least(a.x + a.m + a.w, b.x + b.w) - greatest(a.x + a.m, b.x)) * greatest(0, least(a.y, b.y) + 20 - greatest(a.y, b.y)) AS inter, a.w * 20 + b.w * 20 AS area) o),
k AS (SELECT image, pi, ti, dist AS v, row_number() OVER (PARTITION BY image ORDER BY pi, dist, ti) AS k FROM c WHERE dist <= reach),
g(image, k, ps, ts, pi, ti, v, taken) AS (
  SELECT image, k, [pi], [ti], pi, ti, v, true FROM k WHERE k = 1
  UNION ALL
  SELECT k.image, k.k, CASE WHEN list_contains(g.ps, k.pi) OR list_contains(g.ts, k.ti) THEN g.ps ELSE list_append(g.ps, k.pi) END, CASE WHEN list_contains(g.ps, k.pi) OR list_contains(g.ts, k.ti) THEN g.ts ELSE list_append(g.ts, k.ti) END,
    k.pi, k.ti, k.v, NOT (list_contains(g.ps, k.pi) OR list_contains(g.ts, k.ti)) FROM g JOIN k ON k.image = g.image AND k.k = g.k + 1
)
"""


@query(f"WITH {BOXES} SELECT image, i, round(max(inter / (area - inter)), 9) AS best_iou FROM o GROUP BY image, i")
def box_iou_best(spark: SparkSession, d: str) -> DataFrame:
    out = E.best_iou(boxes(spark, d, 3), boxes(spark, d, 0), "image", "i", "box")
    return out.withColumn("best_iou", F.round("best_iou", 9))


@query(f"WITH RECURSIVE {BOXES}, {GREEDY} SELECT image, pi AS pred_index, ti AS truth_index, round(v, 9) AS iou FROM g WHERE taken")
def greedy_box_match(spark: SparkSession, d: str) -> DataFrame:
    return E.greedy_match(boxes(spark, d, 3), boxes(spark, d, 0), "image", "i", "box").withColumn("iou", F.round("iou", 9))


@query(f"""
WITH RECURSIVE {BOXES}, {GREEDY}, n AS (SELECT image, count(*) AS n FROM t GROUP BY image), m AS (SELECT image, count(*) AS m, sum(v) AS s FROM g WHERE taken GROUP BY image),
r AS (SELECT CAST(sum(coalesce(m, 0)) AS BIGINT) AS tp, CAST(sum(n - coalesce(m, 0)) AS BIGINT) AS fp, sum(s) AS s, count(*) FILTER (WHERE coalesce(m, 0) < n) AS n_missed_images FROM n LEFT JOIN m USING (image))
SELECT tp, fp, fp AS fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fp), 9) AS recall, round(tp / (tp + fp), 9) AS f1, round(s / tp, 9) AS mean_iou, n_missed_images FROM r
""")
def detection_prf(spark: SparkSession, d: str) -> DataFrame:
    """Predictions and truth hold the same number of boxes, so false positives are as many as false negatives."""
    pred, truth = boxes(spark, d, 3), boxes(spark, d, 0)
    out = E.detection_report(E.greedy_match(pred, truth, "image", "i", "box"), pred, truth, "image")
    return out.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "mean_iou")], "n_missed_images")


@query(f"WITH RECURSIVE {BOXES}, {CENTRE} SELECT image, pi AS pred_index, ti AS truth_index FROM g WHERE taken")
def glyph_centre_match(spark: SparkSession, d: str) -> DataFrame:
    b = lambda s: boxes(spark, d, s).select("image", "i", (F.col("box.x") + F.col("box.w") / 2).alias("cx"), (F.col("box.y") + F.col("box.h") / 2).alias("cy"), F.col("box.w").alias("w"), F.col("box.h").alias("h"))
    return E.centre_match(b(3), b(0), "image", "i")
