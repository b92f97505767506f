"""Reports over documents as records of a source, over events as predictions and over rated documents as an annotation round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.operators import annotations as A
from curata.operators import governance as G
from curata.operators import reports as R
from curata.queries._registry import query, table
from curata.queries.annotations import RATINGS, ratings

RANKS = {"expert_annotation": 0, "source_information": 1, "project_annotation": 2}


def records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    site = F.when(k % 7 == 0, None).when(k % 7 == 1, "unknown").otherwise(F.col("source"))
    return table(spark, d, "documents").select(
        "doc_id", F.when(k % 29 != 0, F.col("source")).alias("grp"), F.when(k % 17 != 0, F.col("lang")).alias("label"), F.when(k % 13 == 0, "unknown").otherwise(F.sha2("text", 256)).alias("digest"),
        F.when(k % 3 == 0, -300).alias("low"), F.when(k % 5 == 0, 100).alias("high"), site.alias("site"))


RECORDS = """
r AS (SELECT doc_id, CASE WHEN doc_id % 29 <> 0 THEN source END AS grp, CASE WHEN doc_id % 17 <> 0 THEN lang END AS label, CASE WHEN doc_id % 13 = 0 THEN 'unknown' ELSE sha256(text) END AS digest,
  CASE WHEN doc_id % 3 = 0 THEN -300 END AS low, CASE WHEN doc_id % 5 = 0 THEN 100 END AS high, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 'unknown' ELSE source END AS site FROM documents)
"""


@query(f"""
WITH {RECORDS}, s AS (SELECT grp, count(*) AS m, max(label) AS top FROM r WHERE grp IS NOT NULL GROUP BY grp)
SELECT * FROM (
  SELECT 'records' AS metric, '' AS key, count(*) AS n FROM r UNION ALL SELECT 'without_digest', '', count(*) FILTER (WHERE coalesce(digest = 'unknown', true)) FROM r
  UNION ALL SELECT 'with_bound', '', count(*) FILTER (WHERE low IS NOT NULL OR high IS NOT NULL) FROM r UNION ALL SELECT 'present:site', '', count(*) FILTER (WHERE site <> 'unknown') FROM r
  UNION ALL SELECT 'value:label', coalesce(label, '<absent>'), count(*) FROM r GROUP BY 2 UNION ALL SELECT 'value:site', coalesce(site, '<absent>'), count(*) FROM r GROUP BY 2
  UNION ALL SELECT 'groups', '', count(*) FROM s UNION ALL SELECT 'largest_group', '', coalesce(max(m), 0) FROM s UNION ALL SELECT 'digests', '', count(DISTINCT digest) FROM r WHERE digest <> 'unknown'
  UNION ALL SELECT 'groups_by_label', label, count(DISTINCT grp) FROM r WHERE grp IS NOT NULL AND label IS NOT NULL GROUP BY label UNION ALL SELECT 'groups_by_label', '<absent>', count(*) FROM s WHERE top IS NULL
) WHERE n > 0
""")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    return R.audit(records(spark, d), "grp", "label", "digest", ["site"], ["label", "site"], ("low", "high")).where("n > 0")


@query(f"""
WITH {RECORDS}, f AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'R2' ELSE 'R4' END AS rule FROM documents WHERE doc_id % 10 = 0), p AS (SELECT grp, CASE WHEN length(grp) % 2 = 0 THEN 'train' ELSE 'test' END AS part, count(*) AS m FROM r WHERE grp IS NOT NULL GROUP BY grp)
SELECT 'images' AS metric, '' AS key, count(*) AS n FROM r UNION ALL SELECT 'with_bound', '', count(*) FROM r WHERE low IS NOT NULL OR high IS NOT NULL UNION ALL SELECT 'value:site', coalesce(site, 'unknown'), count(*) FROM r GROUP BY 2
UNION ALL SELECT 'groups', '', count(DISTINCT grp) FROM r UNION ALL SELECT 'findings', rule, count(*) FROM f GROUP BY rule
UNION ALL SELECT 'partition_groups', part, count(*) FROM p GROUP BY part UNION ALL SELECT 'partition_images', part, CAST(sum(m) AS BIGINT) FROM p GROUP BY part
""")
def statistics_report(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    findings = table(spark, d, "documents").where("doc_id % 10 = 0").select(F.when(F.col("doc_id") % 3 == 0, "R2").otherwise("R4").alias("rule"))
    parts = r.where("grp IS NOT NULL").select("grp").distinct().withColumn("partition", F.when(F.length("grp") % 2 == 0, "train").otherwise("test"))
    return R.statistics(r, "grp", ["site"], ("low", "high"), findings, parts)


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang")
def ordered_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.ordered_counts(table(spark, d, "documents"), "lang")


@query("SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    return R.first_seen(table(spark, d, "events"), "event_type", "event_id")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL")
def group_members(spark: SparkSession, d: str) -> DataFrame:
    return R.members(table(spark, d, "documents"), "source", "doc_id").select("source", "doc_id", "position", "n")


@query("SELECT doc_id AS image_id, lang AS script_type, source AS artifact_id, CAST(NULL AS VARCHAR) AS site FROM documents")
def label_view(spark: SparkSession, d: str) -> DataFrame:
    names = {"image_id": "doc_id", "script_type": "lang", "artifact_id": "source"}
    return R.view(table(spark, d, "documents"), [*names, "site"], names).withColumn("site", F.col("site").cast("string"))


@query("""
WITH c(label, status) AS (VALUES ('en', 'trainable'), ('fr', 'trainable'), ('fr', 'held_out'), ('xx', 'held_out')), l AS (SELECT label, count(DISTINCT status) AS m FROM c GROUP BY label), h AS (SELECT DISTINCT lang AS label, true AS here FROM documents WHERE lang IS NOT NULL)
SELECT * FROM (SELECT label, CASE WHEN m IS NULL THEN 'unassigned' WHEN m > 1 THEN 'overlap' WHEN here IS NULL THEN 'unknown' END AS problem FROM l FULL JOIN h USING (label)) WHERE problem IS NOT NULL
""")
def label_coverage(spark: SparkSession, d: str) -> DataFrame:
    return R.label_coverage(table(spark, d, "documents"), "lang", [("en", "trainable"), ("fr", "trainable"), ("fr", "held_out"), ("xx", "held_out")])


@query("""
WITH e AS (SELECT ['a', 'b', 'c'][event_id % 3 + 1] AS t, [x / 20.0, y / 20.0, (20 - x - y) / 20.0] AS p FROM (SELECT event_id, user_id % 11 AS x, event_id % 10 AS y FROM events)),
r AS (SELECT t, list_max(p) AS top, list_position(['a', 'b', 'c'], t) = list_position(p, list_max(p)) AS ok, p[list_position(['a', 'b', 'c'], t)] AS own FROM e)
SELECT metric, key, n, round(value, 9) AS value FROM (
  SELECT CASE WHEN ok THEN 'right' ELSE 'wrong' END AS metric, CAST(least(CAST(floor(top * 10) AS INT), 9) AS VARCHAR) AS key, count(*) AS n, CAST(NULL AS DOUBLE) AS value FROM r GROUP BY 1, 2
  UNION ALL SELECT 'mean_top_by_class', t, count(*), avg(top) FROM r GROUP BY t UNION ALL SELECT 'mean_own_by_class', t, count(*), avg(own) FROM r GROUP BY t
  UNION ALL SELECT 'share_below_half', '', count(*), avg(CASE WHEN top < 0.5 THEN 1.0 ELSE 0 END) FROM r UNION ALL SELECT 'mean', '', count(*), avg(top) FROM r)
""")
def confidence_distribution(spark: SparkSession, d: str) -> DataFrame:
    x, y, names = F.col("user_id") % 11, F.col("event_id") % 10, ["a", "b", "c"]
    rows = table(spark, d, "events").select(F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 3 + 1).cast("int")).alias("t"), F.array(x / 20, y / 20, (20 - x - y) / 20).alias("p"))
    return R.confidence_distribution(rows, "t", "p", names).withColumn("value", F.round("value", 9))


@query(f"""
WITH {RATINGS} SELECT doc_id, arg_min(id, (state <> 'expert_reviewed', CASE kind WHEN 'expert_annotation' THEN 0 WHEN 'source_information' THEN 1 WHEN 'project_annotation' THEN 2 ELSE 3 END, id)) AS basis FROM r WHERE kind <> 'ai_prediction' GROUP BY doc_id
""")
def basis_annotation(spark: SparkSession, d: str) -> DataFrame:
    return R.basis(ratings(spark, d), "doc_id", "kind", "state", "id", "id", RANKS)


@query("""
WITH q AS (SELECT sha256(text) AS digest, max(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), u AS (SELECT doc_id, toxic AS usability FROM labels)
SELECT d.doc_id, CASE WHEN q.doc_id IS NOT NULL THEN q.doc_id % 5 END AS quality, u.usability FROM documents d LEFT JOIN q ON q.digest = sha256(d.text) LEFT JOIN u ON u.doc_id = d.doc_id
""")
def sidecars(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    quality = docs.where("doc_id % 2 = 0").select("digest", (F.col("doc_id") % 5).alias("quality"), "doc_id")
    usability = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("usability"))
    return R.with_sidecars(docs, quality, usability, "digest", "doc_id", "doc_id").select("doc_id", "quality", "usability")


@query(f"""
WITH {RATINGS}, h AS (SELECT * FROM r WHERE kind <> 'ai_prediction'),
g AS (SELECT doc_id, count(*) FILTER (WHERE label = 'unknown' OR state = 'disputed') AS n_incomplete, bool_or(kind = 'expert_annotation') AS e, bool_or(kind = 'project_annotation') AS p FROM h GROUP BY doc_id),
x AS (SELECT doc_id, doc_id % 7 <> 0 AS in_records, concat_ws(',', CASE WHEN NOT coalesce(p, false) THEN 'project_annotation' END, CASE WHEN NOT coalesce(e, false) THEN 'expert_annotation' END) AS missing_tiers, coalesce(n_incomplete, 0) AS n_incomplete,
  CASE WHEN doc_id % 2 = 0 THEN 'provisional' ELSE 'unannotated' END AS status FROM documents LEFT JOIN g USING (doc_id))
SELECT *, in_records AND missing_tiers = '' AND n_incomplete = 0 AS complete FROM x
""")
def round_progress(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    open_points = F.filter(F.array(F.when(F.col("label") == "unknown", "label"), F.when(F.col("state") == "disputed", "state")), lambda x: x.isNotNull())
    status = docs.where("doc_id % 2 = 0").withColumn("status", F.lit("provisional"))
    return R.round_progress(docs, ratings(spark, d), "doc_id", "kind", ["project_annotation", "expert_annotation"], open_points, docs.where("doc_id % 7 <> 0"), status)


@query(f"""
WITH {RATINGS}, c AS (SELECT * FROM r WHERE id % 20 <> 3), s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'expert_label' ELSE 'provisional' END AS status, doc_id % 2 = 0 AS gt FROM documents)
SELECT 'rows' AS metric, '' AS key, count(*) AS n FROM r UNION ALL SELECT 'current', '', count(*) FROM c UNION ALL SELECT 'kind', kind, count(*) FROM c GROUP BY kind
UNION ALL SELECT 'items', '', count(*) FROM s UNION ALL SELECT 'status', status, count(*) FROM s GROUP BY status UNION ALL SELECT 'ground_truth', '', count(*) FROM s WHERE gt
""")
def round_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose id ends in 03, 23 and so on have been superseded."""
    log = ratings(spark, d)
    gone = log.where("id % 20 = 3").select((-F.col("id")).alias("id"), F.col("id").alias("supersedes"))
    current = A.current(log.withColumn("supersedes", F.lit(None).cast("bigint")).unionByName(gone, allowMissingColumns=True), "id", "supersedes").where("id >= 0")
    even = F.col("doc_id") % 2 == 0
    status = table(spark, d, "documents").select("doc_id", F.when(even, "expert_label").otherwise("provisional").alias("status"), even.alias("ground_truth"))
    return R.round_summary(log, current, status, "kind")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def precheck_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.finding_counts(table(spark, d, "events"), "user_id", "event_type")


@query("SELECT DISTINCT lang, 'source' AS field, source AS value FROM documents WHERE source IS NOT NULL UNION ALL SELECT DISTINCT lang, 'size_class', CAST(n_chars // 1000 AS VARCHAR) FROM documents WHERE n_chars IS NOT NULL")
def manifest_values(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", "source", F.floor(F.col("n_chars") / 1000).alias("size_class"))
    return R.manifest_values(docs, "lang", ["source", "size_class"])


@query("SELECT lang, count(*) AS n_files, count(DISTINCT source) AS n_groups, count(DISTINCT sha256(text)) AS n_digests, bool_or(n_chars > 50000) AS share_alike, count(*) FILTER (WHERE doc_id % 4 = 0) AS n_attributed FROM documents GROUP BY lang")
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("h", F.sha2("text", 256))
    return R.manifest_counts(docs, "lang", "source", "h", F.col("n_chars") > 50000, F.col("doc_id") % 4 == 0)


@query("""
WITH s AS (SELECT o_custkey AS batch, o_orderkey AS title, CASE WHEN o_orderkey % 10 IN (0, 1) THEN 'rejected' WHEN o_orderkey % 9 = 0 THEN 'already_present' ELSE 'planned' END AS st, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS sz,
  CASE WHEN o_orderkey % 10 = 0 THEN 'not found at the source' WHEN o_orderkey % 10 = 1 THEN 'license' END AS w FROM orders),
t AS (SELECT batch, sum(sz) FILTER (WHERE st = 'planned') AS total FROM s GROUP BY batch)
SELECT batch, title, CASE WHEN st = 'planned' AND total > 1500000 THEN 'rejected' ELSE st END AS status, CASE WHEN st = 'planned' AND total > 1500000 THEN 'batch over budget' ELSE w END AS why, sz AS size_bytes FROM s JOIN t USING (batch)
""")
def acquisition_plan(spark: SparkSession, d: str) -> DataFrame:
    """An order is an item; those ending in 0 are not described, in 1 not accepted; those divisible by 9 are in the registry."""
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "title")
    fine = F.col("title") % 10 != 1
    described = o.where("title % 10 <> 0").select("title", F.col("title").alias("image_id"), F.floor("o_totalprice").alias("size_bytes"), fine.alias("accepted"), F.when(~fine, "license").alias("why"))
    registry = o.where("title % 9 = 0").select(F.col("title").alias("image_id"))
    return R.acquisition_plan(o.select(F.col("o_custkey").alias("batch"), "title"), described, registry, "batch", "title", 1_500_000)


def knowledge(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as entries of a brand, brands as references, nations as configured positions."""
    k, brand = F.col("p_partkey"), F.col("p_brand")
    said = F.struct(F.array(brand).alias("reference_ids"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("statement"))
    entries = table(spark, d, "part").select(
        F.concat(F.lit("p"), k.cast("string")).alias("id"), F.col("p_type").alias("kind"), F.when(k % 3 != 0, F.array(brand)).alias("reference_ids"), F.when(k % 4 != 0, F.col("p_name")).otherwise("").alias("printed"),
        F.when(k % 5 != 0, F.array(said)).alias("assertions"), F.when(k % 2 == 0, "verified_against_source").otherwise("unverified").alias("verification_status"), F.when(k % 6 != 0, "me").alias("verified_by"), F.when(k % 7 != 0, "2024-01-01").otherwise("unknown").alias("verified_on"))
    n = F.col("n_nationkey").cast("string")
    return entries, table(spark, d, "nation").select(n.alias("id"), F.concat(F.lit("Brand#"), n).alias("reference"), F.col("n_name").alias("label"))


@query("""
SELECT 'p' || p_partkey AS claim_id, p_brand AS refs, CASE WHEN p_partkey % 4 <> 0 THEN p_name ELSE 'p' || p_partkey END AS statement, 'knowledge/' || p_type AS recorded_in FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT 'p' || p_partkey || '.assertions[0]', p_brand, 'size ' || p_size, 'knowledge/' || p_type FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT 'config:position_' || n_nationkey, 'Brand#' || n_nationkey, n_name, 'config' FROM nation
""")
def knowledge_claims(spark: SparkSession, d: str) -> DataFrame:
    return G.knowledge_claims(*knowledge(spark, d)).select("claim_id", F.array_join("ref_ids", ",").alias("refs"), "statement", "recorded_in")


@query("""
SELECT 'p' || p_partkey AS id, 'K5' AS rule FROM part WHERE p_partkey % 2 = 0 AND (p_partkey % 6 = 0 OR p_partkey % 7 = 0) UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'K7' FROM nation WHERE 'Brand#' || n_nationkey NOT IN (SELECT p_brand FROM part)
""")
def knowledge_sources(spark: SparkSession, d: str) -> DataFrame:
    entries, positions = knowledge(spark, d)
    return G.source_problems(entries, positions, table(spark, d, "part").select(F.col("p_brand").alias("id"))).select("id", "rule")
