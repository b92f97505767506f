"""Mixing sources to target weights by weighted fair queueing.

Sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share the budget, which is the sum of all sizes; a target
stops at ``REPEATS`` times its source's size and the excess goes to the others by weight (water-filling). Each document, shuffled by a hash, may be
sent up to REPEATS times; sending e (from 0) has the virtual finish time (e * source size + sizes up to and with this document in its
source) / target. All sendings are sorted by it over the whole cluster, and the mix is the longest prefix of them within the budget.

All running sums, those within sources, over finish times and over the sources themselves, are range sorts (``running_sums``): rows are dealt by ranges of the whole sort key, so
a source of any share is spread over many tasks, and so are many sources; each task adds up its range, and the few range totals give the offsets.

Defined cases: a null or empty text has size 0 and is never taken; a null source is one source, the last; equal rows are
interchangeable and each may be taken; with no words at all every target is 0. Other columns, of any names, do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import _base
from curata.operators.ordering import running_sums

SPACE = " \t\n\x0b\f\r"
#: A word and the white space behind it: such pieces make up a text that begins with a word.
PIECE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
REPEATS = 3
WEIGHTS = 3
#: Up to so many sources their table is broadcast (some 10 MB); beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def sizes(docs: DataFrame, text_col: str = "text") -> F.Column:
    """Number of words, as the length of the text with one letter for each; regexp_count would first make an array of all words."""
    pieces = F.regexp_replace(F.ltrim(F.col(f"`{text_col}`"), F.lit(SPACE)), PIECE, "x")
    return F.coalesce(F.length(pieces).cast("long"), F.lit(0).cast("long"))


def targets(base: DataFrame) -> DataFrame:
    """One row for each source: skey, source_size, target, rank and the budget."""
    s = _base.materialize(base.groupBy("skey").agg(F.sum("size").alias("source_size")), "sources")
    n = s.count()
    s = running_sums(s, ["skey"], {"rank": None}, rows=n)
    s = s.withColumn("w", (F.col("rank") - 1) % WEIGHTS + 1).withColumn("cap", F.col("source_size") * REPEATS).withColumn("full_at", F.col("cap") / F.col("w"))
    # sources by the level at which they are full; below the water line a source is full, above it all rise alike
    s = _base.materialize(running_sums(s, ["full_at", "rank"], {"cap_upto": "cap", "w_upto": "w"}, rows=n), "levels", n)
    whole = F.broadcast(s.agg(F.sum("w").alias("w_all"), F.sum("source_size").alias("budget")))
    s = s.join(whole).withColumn("level", (F.col("budget") - F.col("cap_upto") + F.col("cap")).cast("double") / (F.col("w_all") - F.col("w_upto") + F.col("w")))
    line = s.agg(F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level")))["level"].alias("line"))
    return s.join(F.broadcast(line)).select("skey", "source_size", F.least(F.col("cap").cast("double"), F.col("line") * F.col("w")).alias("target"), "rank", "budget")


RESULT = ("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = (), seed: str = "mix") -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken (words; a multiple of size), and the columns ``carry``, none of which may be named as one of these."""
    if clash := set(carry) & set(RESULT):
        raise ValueError(f"columns to carry have names of the result: {sorted(clash)}")
    return _mix(_base.materialize(_sized(docs, sizes(docs, text_col), id_col, source_col, carry, seed), "sizes"), carry)


def _sized(docs: DataFrame, size: F.Column, id_col: str, source_col: str, carry: Sequence[str], seed: str = "mix") -> DataFrame:
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`")), F.lit("t")).alias("skey"), size.alias("size"),
        F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long").alias("shuffle"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("carried"),
    )


def _mix(base: DataFrame, carry: Sequence[str]) -> DataFrame:
    """The mix of rows as _sized makes them, whose sizes are written already."""
    table = _base.materialize(targets(base), "targets")
    small = table.count() <= BROADCAST_SOURCES
    side = F.broadcast(table) if small else table
    placed = running_sums(base, ["skey", "shuffle", "doc_id", "size"], {"pos": "size"}, by=1, row_id="row").join(side, "skey")
    sent = F.explode(F.sequence(F.lit(0), F.when(F.col("size") > 0, REPEATS - 1).otherwise(0)))
    items = placed.select("row", "doc_id", "size", "source_size", "target", "rank", "shuffle", "budget", "carried", "pos", sent.alias("e"))
    items = items.withColumn("finish", F.coalesce(F.try_divide((F.col("e") * F.col("source_size") + F.col("pos")).cast("double"), F.col("target")), F.lit(0.0)))
    queue = running_sums(items.drop("pos"), ["finish", "rank", "e", "shuffle", "doc_id", "size"], {"total": "size"})
    rest = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target", "carried")]
    taken = F.sum(F.when(F.col("total") <= F.col("budget"), F.col("size")).otherwise(0)).alias("taken")
    return queue.groupBy("row").agg(*rest, taken).select(*RESULT, *[F.col("carried").getField(c).alias(c) for c in carry])


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: each row as often as it is taken, columns as they were."""
    row, size, times = (_base.fresh(docs, x) for x in ("row_number", "n_words", "times"))
    rows = _base.materialize(docs.withColumns({row: F.monotonically_increasing_id(), size: sizes(docs, text_col)}), "rows")
    plan = _mix(_sized(rows, F.col(size), id_col, source_col, [row]), [row]).where("taken > 0").select(row, (F.col("taken") / F.col("size")).cast("int").alias(times))
    taken = rows.join(plan, row)
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_base.read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce('s' || source, 't') AS skey, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS shuffle
  FROM documents
),
s0 AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY skey),
s1 AS (SELECT *, row_number() OVER (ORDER BY skey) AS rank FROM s0),
s2 AS (SELECT *, (rank - 1) % 3 + 1 AS w, 3 * source_size AS cap, (SELECT CAST(sum(source_size) AS BIGINT) FROM s0) AS budget FROM s1),
s3 AS (
  SELECT *, CAST(sum(cap) OVER f AS BIGINT) - cap AS full_before, (SELECT sum(w) FROM s2) - sum(w) OVER f + w AS w_left, row_number() OVER (ORDER BY cap / w, rank) AS place
  FROM s2 WINDOW f AS (ORDER BY cap / w, rank ROWS UNBOUNDED PRECEDING)
),
s4 AS (SELECT *, CAST(budget - full_before AS DOUBLE) / CAST(w_left AS DOUBLE) AS level FROM s3),
line AS (SELECT level FROM s4 WHERE level <= cap / w ORDER BY place LIMIT 1),
tg AS (SELECT skey, source_size, rank, budget, least(CAST(cap AS DOUBLE), (SELECT level FROM line) * w) AS target FROM s4),
p AS (SELECT b.*, row_number() OVER () AS row, CAST(sum(size) OVER (PARTITION BY skey ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pos FROM base b),
i AS (SELECT p.*, tg.source_size, tg.target, tg.rank, tg.budget, e.e FROM p JOIN tg USING (skey), (SELECT unnest([0, 1, 2]) AS e) e WHERE p.size > 0),
q AS (
  SELECT *, sum(size) OVER (ORDER BY CAST(e * source_size + pos AS DOUBLE) / target, rank, e, shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) AS total FROM i
),
t AS (SELECT row, CAST(sum(size) AS BIGINT) AS taken FROM q WHERE total <= budget GROUP BY row)
SELECT p.doc_id, p.size, tg.source_size, tg.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken FROM p JOIN tg USING (skey) LEFT JOIN t USING (row)
"""
