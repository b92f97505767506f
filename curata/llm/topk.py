"""Exact top-k by inner product: columnar branch-and-bound.

A vector's components become floor(256 x). Queries are written once, dealt to blocks of about ``BLOCK``; each block is a bounded broadcast and one
pass over the candidates, whose result is appended to a table before the next. A task holds chunks of candidates in vertical layout, one row a dimension. Scores accumulate
dimension block by dimension block; after each, a candidate survives only if its partial score and the most that the remaining dimensions can give
(Cauchy-Schwarz over the remaining norms) reach the query's k-th best so far, and the survivors are compacted. What a task sends on is k
rows a query; those are ranked by query.

Scores are exact. Doubles hold sums of whole numbers up to 2**53; a query and chunk whose products may pass that go through the same bounds, widened by what doubles may
err, and the survivors alone are scored in Python's integers. A score beyond a long is given as the nearest long, and ranked by what it is.

Defined cases: vectors null, or with null or non-finite components (also after the product with 256), take no part; vectors meet only those of their own length;
rows that repeat a query's id and vector are one query, but each is a candidate of other queries; rows with the query's own id are no candidates of it;
null ids take no part. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.llm import _base

BLOCK = 4096
CHUNK = 8192
STEP = 16
EVERY = 50
K = 5
EXACT = 2**53
LARGEST = np.finfo(np.float64).max
LONGEST = 2**63 - 1


def to_integers(rows: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * rows.astype(np.float64))


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, vectors, k
        dims = vectors.shape[1]
        self.edges = [*range(0, dims, STEP), dims]
        with np.errstate(over="ignore"):
            # the norm of what is left of a query from each edge on
            self.left = np.stack([np.sqrt((vectors[:, e:] ** 2).sum(axis=1)) for e in self.edges], axis=1)
        self.most = np.abs(vectors).max(axis=1, initial=0.0)
        self.scores: list[np.ndarray] = [np.empty(0)] * len(ids)
        self.found: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(ids)
        self.bar = np.full(len(ids), -math.inf)

    def offer(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merges candidates of query i into its k best."""
        if scores.dtype == object and self.scores[i].dtype != object:
            self.scores[i] = np.array([int(x) for x in self.scores[i]], dtype=object)
        elif self.scores[i].dtype == object and scores.dtype != object:
            scores = np.array([int(x) for x in scores], dtype=object)
        s, d = (np.concatenate([self.scores[i], scores]), np.concatenate([self.found[i], ids])) if len(self.found[i]) else (scores, ids)
        if s.dtype == object:
            order = np.array(sorted(range(len(s)), key=lambda j: (-s[j], d[j]))[: self.k], dtype=np.int64)
        else:
            if len(s) > self.k:
                keep = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
                s, d = s[keep], d[keep]
            order = np.lexsort((d, -s))[: self.k]
        self.scores[i], self.found[i] = s[order], d[order]
        if len(order) == self.k:
            self.bar[i] = np.nextafter(float(max(-LARGEST, min(LARGEST, self.scores[i][-1]))), -math.inf)

    @np.errstate(over="ignore", invalid="ignore")
    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """All queries against a chunk of candidates. What overflows compares as unknown, and survives."""
        columns = np.ascontiguousarray(vectors.T)
        dims = len(columns)
        left = np.stack([np.sqrt((columns[e:] ** 2).sum(axis=0)) for e in self.edges])
        most = np.abs(columns).max(initial=0.0)
        first = self.edges[1] if len(self.edges) > 1 else 0
        for at in range(0, len(self.ids), 256):
            opening = self.q[at : at + 256, :first] @ columns[:first]
            for j, partial in enumerate(opening):
                i = at + j
                inexact = not (self.most[i] + 1) * (most + 1) * dims < EXACT
                slack = left[0] * (self.left[i, 0] * 4 * (dims + 1) / EXACT) if inexact else None
                alive = None
                for n, edge in enumerate(self.edges[1:], 1):
                    if n > 1:
                        block = columns[self.edges[n - 1] : edge]
                        partial = partial + self.q[i, self.edges[n - 1] : edge] @ (block if alive is None else block[:, alive])
                    if self.bar[i] > -math.inf:
                        reach = partial + self.left[i, n] * (left[n] if alive is None else left[n][alive]) * (1 + 1e-9) + 0.5
                        if inexact:
                            reach = reach + (slack if alive is None else slack[alive])
                        stays = np.flatnonzero(~(reach < self.bar[i]))
                        if len(stays) < len(partial):
                            alive, partial = (stays if alive is None else alive[stays]), partial[stays]
                    if not len(partial):
                        break
                if len(partial):
                    own = ids if alive is None else ids[alive]
                    other = np.flatnonzero(own != self.ids[i])
                    if len(other):
                        scores = partial[other]
                        if inexact:
                            mine = [int(x) for x in self.q[i]]
                            rows = vectors[other if alive is None else alive[other]]
                            scores = np.empty(len(other), dtype=object)
                            scores[:] = [sum(a * int(b) for a, b in zip(mine, v, strict=True)) for v in rows]
                        self.offer(i, scores, own[other])

    def rows(self) -> Iterator[tuple[int, int, int, int, int, str | None]]:
        """Query's number and id, candidate's id, score as a long, and, of one beyond a long, which side of it and a text that sorts as it does."""
        for i, (s, d) in enumerate(zip(self.scores, self.found, strict=True)):
            for a, b in zip(map(int, s), d, strict=True):
                over = (a > LONGEST) - (a < -LONGEST - 1)
                yield i, int(self.ids[i]), int(b), max(-LONGEST - 1, min(LONGEST, a)), over, f"{a + 10**639:0640d}" if over else None


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer vectors) of a batch, for each length of vector."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield ids[rows].astype(np.int64), to_integers(values[starts[rows][:, None] + np.arange(n)].reshape(len(rows), n))


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * 256) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad)


def top_k(vectors: DataFrame, is_query: F.Column | str, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. is_query is a condition on vec_id. The driver holds one block of queries at a time."""
    spark = vectors.sparkSession
    _base.ship(spark)
    all_rows = valid(vectors, id_col, vector_col)
    queries = _base.materialize(all_rows.where(is_query).distinct(), "queries")
    blocks = max(1, -(-queries.count() // block))
    if blocks > 1:
        path = _base.shared_dir(spark, "query_blocks")
        queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(path)
        queries = spark.read.schema("vec_id long, v array<double>, block long").parquet(path)
    found = _base.shared_dir(spark, "found")
    for b in range(blocks):
        one = (queries.where(F.col("block") == b) if blocks > 1 else queries).select("vec_id", "v").toArrow().combine_chunks()
        parts: dict[int, list] = {}
        for rb in one.to_batches():
            for ids, v in by_length(rb):
                parts.setdefault(v.shape[1], []).append((ids, v))
        sent = spark.sparkContext.broadcast([(np.concatenate([x for x, _ in p]), np.concatenate([x for _, x in p])) for p in parts.values()])
        _meet(all_rows, sent, k).withColumn("block", F.lit(b)).write.mode("append").parquet(found)
        sent.destroy()
    order = Window.partitionBy("block", "of").orderBy(F.desc("over"), F.desc("key"), F.desc("score"), "vec_id")
    rows = spark.read.schema(f"{FOUND}, block int").parquet(found)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


FOUND = "of string, query_id long, vec_id long, score long, over int, key string"


def _meet(candidates: DataFrame, sent: Broadcast, k: int) -> DataFrame:
    """The k best of each task's candidates for each query of a broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {v.shape[1]: Best(ids, v, k) for ids, v in sent.value}
        held: dict[int, list] = {}

        def close(n: int) -> None:
            best[n].meet(np.concatenate([x for x, _ in held[n]]), np.concatenate([x for _, x in held[n]]))
            held[n] = []

        for batch in batches:
            for ids, v in by_length(batch):
                if (n := v.shape[1]) in best:
                    held.setdefault(n, []).append((ids, v))
                    if sum(len(x) for x, _ in held[n]) >= CHUNK:
                        close(n)
        for n in [n for n, part in held.items() if part]:
            close(n)
        rows = [(f"{n}:{i}", *rest) for n, x in best.items() for i, *rest in x.rows()]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 50_000], strict=True), types, strict=True)], names=["of", "query_id", "vec_id", "score", "over", "key"])

    return candidates.mapInArrow(run, FOUND)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_base.read(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
