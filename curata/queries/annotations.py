"""Conversations as an annotation log: item conv_id, author role, id conv_id * 1000 + turn; a turn supersedes the role's turn before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.operators import annotations as A
from curata.queries._registry import query, table


def log(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "role", "text")
    return c.withColumn("supersedes", F.lag("id").over(Window.partitionBy("conv_id", "role").orderBy("turn")))


LOG = "l AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text, lag(conv_id * 1000 + turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS supersedes FROM conversations)"


@query(f"WITH {LOG} SELECT id, conv_id, role FROM l WHERE id NOT IN (SELECT supersedes FROM l WHERE supersedes IS NOT NULL)")
def current_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return A.current(log(spark, d), "id", "supersedes").select("id", "conv_id", "role")


def faulty_log(spark: SparkSession, d: str) -> DataFrame:
    """Turn 4 supersedes turn 0 once more, turn 5 an id that is not there, turn 6 the other role's turn 5."""
    t = F.col("turn")
    wrong = F.when(t == 4, F.col("conv_id") * 1000).when(t == 5, F.lit(-1)).when(t == 6, F.col("conv_id") * 1000 + 5).otherwise(F.col("supersedes"))
    return log(spark, d).withColumn("supersedes", wrong)


@query(f"""
WITH {LOG}, x AS (SELECT id, conv_id, role, CASE turn WHEN 4 THEN conv_id * 1000 WHEN 5 THEN -1 WHEN 6 THEN conv_id * 1000 + 5 ELSE supersedes END AS supersedes FROM l),
j AS (SELECT x.id, CASE WHEN o.id IS NULL THEN 'unknown_target' WHEN x.conv_id <> o.conv_id THEN 'other_item' WHEN x.role <> o.role THEN 'other_author' END AS problem FROM x LEFT JOIN x o ON x.supersedes = o.id WHERE x.supersedes IS NOT NULL)
SELECT supersedes AS id, 'superseded_twice' AS problem FROM x WHERE supersedes IS NOT NULL GROUP BY supersedes HAVING count(*) > 1 UNION ALL SELECT id, problem FROM j WHERE problem IS NOT NULL
""")
def superseded_twice(spark: SparkSession, d: str) -> DataFrame:
    return A.supersession_problems(faulty_log(spark, d), "id", "supersedes", "conv_id", "role")


@query("""
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS i, count(*) OVER (PARTITION BY conv_id) AS n, sha256(text) AS h FROM conversations),
c(conv_id, i, n, head) AS (
  SELECT conv_id, i, n, sha256(repeat('0', 64) || h) FROM t WHERE i = 1
  UNION ALL SELECT t.conv_id, t.i, t.n, sha256(c.head || t.h) FROM c JOIN t ON t.conv_id = c.conv_id AND t.i = c.i + 1
)
SELECT conv_id, CAST(n AS INT) AS n_lines, head FROM c WHERE i = n
""")
def ledger_chain(spark: SparkSession, d: str) -> DataFrame:
    return A.ledger_heads(table(spark, d, "conversations"), "conv_id", ["turn", "role"], "text")


@query("SELECT conv_id, count(*) AS n_lines, count(*) - (CASE WHEN conv_id % 10 = 0 THEN 1 ELSE 0 END) AS sealed_n, CASE WHEN conv_id % 10 = 0 THEN 'TAMPERED_OR_UNSEALED' ELSE 'INTACT' END AS status FROM conversations GROUP BY conv_id")
def ledger_verify(spark: SparkSession, d: str) -> DataFrame:
    """Against entries made before the last line of each tenth log came."""
    c = table(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("m"))
    before = c.join(last, "conv_id").where("conv_id % 10 <> 0 OR turn < m")
    found = A.verify_ledger(c, "conv_id", ["turn", "role"], "text", A.ledger_heads(before, "conv_id", ["turn", "role"], "text"))
    return found.withColumns({"n_lines": F.col("n_lines").cast("long"), "sealed_n": F.coalesce(F.col("sealed_n"), F.lit(0)).cast("long")})


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """Three raters of labelled documents: the language, and variants of it by id; an expert, a curator, a model; a few adjudications."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")
    i = F.col("doc_id")
    none = F.array().cast("array<bigint>")
    one = lambda rater, kind, state, label, adj, res: F.struct(F.lit(rater).alias("rater"), F.lit(kind).alias("kind"), state.alias("state"), label.alias("label"), F.lit(adj).alias("adj"), res.alias("res"))
    draft, reviewed = F.lit("draft"), F.lit("expert_reviewed")
    raters = F.array(
        one("r1", "expert_annotation", F.when(i % 13 == 0, "disputed").otherwise("expert_reviewed"), F.col("lang"), False, none),
        one("r2", "project_annotation", draft, F.when(i % 4 == 0, "unknown").otherwise(F.col("lang")), False, none),
        one("r3", "ai_prediction", draft, F.lit("xx"), False, none),
        one("r4", "expert_annotation", reviewed, F.lit("adj"), True, F.when(i % 3 == 0, F.array(i * 10 + 1, i * 10 + 2)).otherwise(F.array(i * 10 + 1))),
    )
    rows = docs.select("doc_id", F.posexplode(raters).alias("k", "r")).select("doc_id", (i * 10 + F.col("k") + 1).alias("id"), "k", "r.*")
    return rows.where("(k = 0 AND doc_id % 3 <> 1) OR (k = 1 AND doc_id % 5 <> 0) OR k = 2 OR (k = 3 AND doc_id % 6 < 2)")


RATINGS = """
d AS (SELECT doc_id, lang FROM documents JOIN labels USING (doc_id)),
r AS (
  SELECT doc_id, doc_id * 10 + 1 AS id, 'r1' AS rater, 'expert_annotation' AS kind, CASE WHEN doc_id % 13 = 0 THEN 'disputed' ELSE 'expert_reviewed' END AS state, lang AS label, false AS adj, [] AS res FROM d WHERE doc_id % 3 <> 1
  UNION ALL SELECT doc_id, doc_id * 10 + 2, 'r2', 'project_annotation', 'draft', CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE lang END, false, [] FROM d WHERE doc_id % 5 <> 0
  UNION ALL SELECT doc_id, doc_id * 10 + 3, 'r3', 'ai_prediction', 'draft', 'xx', false, [] FROM d
  UNION ALL SELECT doc_id, doc_id * 10 + 4, 'r4', 'expert_annotation', 'expert_reviewed', 'adj', true, CASE WHEN doc_id % 3 = 0 THEN [doc_id * 10 + 1, doc_id * 10 + 2] ELSE [doc_id * 10 + 1] END FROM d WHERE doc_id % 6 < 2
)
"""


@query(f"""
WITH {RATINGS}, a AS (SELECT * FROM r WHERE adj),
g AS (
  SELECT r.doc_id, count(*) FILTER (WHERE r.kind <> 'ai_prediction') AS h, max(a.id) AS adj, max(a.label) AS adj_label,
    count(*) FILTER (WHERE r.kind <> 'ai_prediction' AND a.id IS NOT NULL AND r.id <> a.id AND NOT list_contains(a.res, r.id)) AS u,
    count(*) FILTER (WHERE r.kind <> 'ai_prediction' AND r.state = 'disputed') AS dis, count(*) FILTER (WHERE r.kind = 'expert_annotation' AND r.state = 'expert_reviewed') AS ex,
    min(r.label) FILTER (WHERE r.kind = 'expert_annotation' AND r.state = 'expert_reviewed') AS e0, max(r.label) FILTER (WHERE r.kind = 'expert_annotation' AND r.state = 'expert_reviewed') AS e1,
    min(r.label) FILTER (WHERE r.kind <> 'ai_prediction') AS h0, max(r.label) FILTER (WHERE r.kind <> 'ai_prediction') AS h1
  FROM r LEFT JOIN a USING (doc_id) GROUP BY r.doc_id
),
s AS (SELECT *, CASE WHEN h = 0 THEN 'unannotated' WHEN adj IS NOT NULL AND u > 0 THEN 'disputed' WHEN adj IS NOT NULL THEN 'adjudicated' WHEN dis > 0 THEN 'disputed' WHEN ex > 0 AND e0 = e1 AND e0 <> 'unknown' THEN 'expert_label'
  WHEN ex > 0 THEN 'disputed' WHEN h0 = h1 THEN 'provisional' ELSE 'project_disagreement' END AS status FROM g)
SELECT doc_id, status, CASE status WHEN 'adjudicated' THEN nullif(adj_label, 'unknown') WHEN 'expert_label' THEN e0 WHEN 'provisional' THEN nullif(h0, 'unknown') END AS label,
  status = 'expert_label' OR (status = 'adjudicated' AND adj_label <> 'unknown') AS ground_truth FROM s
""")
def resolve_status(spark: SparkSession, d: str) -> DataFrame:
    return A.resolve(ratings(spark, d), "doc_id", "kind", "state", "label", "adj", "id", "id", "res")


@query(f"""
WITH {RATINGS}, h AS (SELECT * FROM r WHERE kind <> 'ai_prediction'), l AS (SELECT doc_id, 'label' AS field, label AS value FROM h UNION ALL SELECT doc_id, 'state', state FROM h)
SELECT doc_id, field, CAST(count(DISTINCT value) AS INT) AS n_values, string_agg(DISTINCT value, '|' ORDER BY value) AS values FROM l WHERE value NOT IN ('unknown', 'not_assessed') GROUP BY doc_id, field HAVING count(DISTINCT value) > 1
""")
def disagreements(spark: SparkSession, d: str) -> DataFrame:
    rows = ratings(spark, d).where("kind <> 'ai_prediction'")
    return A.disagreements(rows, "doc_id", "rater", "id", ["label", "state"])


@query(f"""
WITH {RATINGS}, a AS (SELECT doc_id, label FROM r WHERE rater = 'r1'), b AS (SELECT doc_id, label FROM r WHERE rater = 'r2'), i AS (SELECT DISTINCT doc_id FROM r)
SELECT i.doc_id, CASE WHEN b.doc_id IS NOT NULL THEN a.label END AS value_a, CASE WHEN a.doc_id IS NOT NULL THEN b.label END AS value_b,
  CASE WHEN a.doc_id IS NULL AND b.doc_id IS NULL THEN 'no current row by r1 or r2' WHEN a.doc_id IS NULL THEN 'no current row by r1' WHEN b.doc_id IS NULL THEN 'no current row by r2' END AS skipped
FROM i LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)
""")
def rater_pairs(spark: SparkSession, d: str) -> DataFrame:
    return A.pair_raters(ratings(spark, d), "doc_id", "rater", "r1", "r2", "label")


@query(f"""
WITH {RATINGS}, v AS (SELECT doc_id, count(DISTINCT nullif(label, 'unknown')) AS n, min(nullif(label, 'unknown')) AS x FROM r WHERE kind <> 'ai_prediction' AND NOT adj GROUP BY doc_id),
p AS (SELECT v.doc_id, 'lang' AS field, CASE WHEN doc_id % 6 = 0 THEN 'zz' ELSE d.lang END AS before, CASE WHEN n = 1 THEN x WHEN n > 1 THEN 'disputed' END AS after FROM v JOIN d USING (doc_id))
SELECT doc_id, field, before, after FROM p WHERE after IS NOT NULL AND before IS DISTINCT FROM after
""")
def promotion_plan(spark: SparkSession, d: str) -> DataFrame:
    votes = ratings(spark, d).where("kind <> 'ai_prediction' AND NOT adj").select("doc_id", F.nullif("label", F.lit("unknown")).alias("lang"))
    return A.promotion_plan(votes, "doc_id", ["lang"], records(spark, d))


def records(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id")
    return docs.select("doc_id", F.when(F.col("doc_id") % 6 == 0, "zz").otherwise(F.col("lang")).alias("lang"), "source")


@query("SELECT doc_id, 'lang,source' AS changed FROM documents WHERE doc_id % 14 = 0 UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'lang' ELSE 'source' END FROM documents WHERE doc_id % 14 <> 0 AND (doc_id % 2 = 0 OR doc_id % 7 = 0)")
def field_diff(spark: SparkSession, d: str) -> DataFrame:
    before = table(spark, d, "documents").select("doc_id", "lang", "source")
    after = before.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "new").otherwise(F.col("lang")), "source": F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source"))})
    return A.field_diff(before, after, "doc_id", ["lang", "source"])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Last write wins: the first half of the events is the registry, the second comes in."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return A.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id").select("user_id", "event_type", "event_id")
