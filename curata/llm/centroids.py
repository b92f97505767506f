"""Centroid clustering in whole numbers: float32 screening with rigorous rounding-error intervals, exact integers where they overlap.

A component becomes floor(256 x). Each round is one pass over the vectors and one aggregate: a task multiplies a batch with the centroids in float32, which gives
|c|^2 - 2 x.c for each pair, and an interval around it that holds the true value. A centroid whose interval begins above another's end is out; where one is left it is the nearest, and
where several are left their distances are computed in integers, ties going to the lowest number.

**The interval.** u = 2**-24. Components and their float32 forms differ by a factor within 1 +- u; a float32 product of n terms, in whatever order it is summed, errs by at most n u / (1 - n u) of the sum
of absolute terms, which is at most |x| |c|. Components are whole numbers, so no product is subnormal. What overflows is unknown, and unknown centroids are never out.

**Sums.** A task sends, for each cluster it has seen, the count and the exact sum of each dimension, in parts of 32 bits; Spark adds them up, by cluster and dimension. The driver holds the
centroids: ``k`` times ``dims`` whole numbers of Python, however large the table. The vectors are read again each round from the given frame: give it a table, or something as cheap and as repeatable.

Defined cases: vectors null, of another length, or with null or non-finite components (also after the product with 256) take no part. Fewer vectors than k give as many centroids. Rows with a null id are
assigned and counted but start no centroid, so a table of them alone has no clusters and no rows come out; repeated rows are vectors of their own, and equal starts are both centroids (the lower number then takes all).
Distances and inertias beyond a long are given as the largest long, and ranked by what they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm import _base
from curata.llm.topk import LONGEST

K, DIMS, ROUNDS, SEED = 40, 64, 5, "2"
#: Vectors of a batch that are screened at a time.
CHUNK = 4096
UNIT = 2.0**-24
LIMB = 32


def kept(batch: pa.RecordBatch, dims: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and floor(256 x) of the vectors that take part, as doubles."""
    ids, lists = batch.column(0), batch.column(1)
    sizes = np.where(np.asarray(lists.is_valid()), np.diff(lists.offsets.to_numpy()), -1)
    at = np.flatnonzero(sizes == dims)
    starts = lists.offsets.to_numpy()[:-1][at]
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    with np.errstate(over="ignore", invalid="ignore"):
        v = np.floor(256.0 * values[starts[:, None] + np.arange(dims)]).reshape(len(at), dims)
    good = np.isfinite(v).all(axis=1)
    return ids.take(pa.array(at[good])), v[good]


class Centroids:
    """The centroids of a round, and the nearest of each vector."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.rows = rows
        dims = len(rows[0])
        self.large = max((abs(x) for r in rows for x in r), default=0)
        self.whole = np.array(rows, dtype=np.int64 if self.large < 2**62 else object)
        double = np.array([[float(x) for x in r] for r in rows])
        with np.errstate(over="ignore"):
            self.single = double.astype(np.float32)
            self.squares = np.array([float(sum(x * x for x in r)) for r in rows])
            self.norms = np.sqrt(self.squares) * (1 + 1e-12)
        n = dims * UNIT
        # both factors rounded to float32, the product's sum, and a little for this line's own rounding
        self.share = ((1 + UNIT) ** 2 * (1 + n / (1 - n)) - 1) * (1 + 1e-6) if n < 0.5 else np.inf

    def screen(self, v: np.ndarray) -> np.ndarray:
        """For each vector and centroid: may it be the nearest?"""
        with np.errstate(over="ignore", invalid="ignore"):
            products = (v.astype(np.float32) @ self.single.T).astype(np.float64)
            norms = np.sqrt((v * v).sum(axis=1)) * (1 + 1e-12)
            scale = norms[:, None] * self.norms
            middle = np.where(np.isfinite(products), self.squares - 2 * products, np.nan)
            # 2**-49 of all that was added: the doubles' own rounding
            slack = 2 * self.share * scale + 2.0**-49 * (self.squares + 2 * scale) + 1e-300
            low, high = middle - slack, middle + slack
        bar = np.where(np.isnan(high), np.inf, high).min(axis=1)
        return ~(low > bar[:, None])

    def exact(self, v: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances of vectors to the centroids ``at``: as integers of 64 bits where they hold them, else Python's."""
        most = np.abs(v).max(initial=0.0)
        if (most + float(self.large)) ** 2 * v.shape[1] < 2.0**62 and self.whole.dtype != object:
            d = v.astype(np.int64) - self.whole[at]
            return np.einsum("ij,ij->i", d, d)
        out = np.empty(len(v), dtype=object)
        out[:] = [sum((int(x) - c) ** 2 for x, c in zip(row, self.rows[j], strict=True)) for row, j in zip(v, at, strict=True)]
        return out

    def nearest(self, v: np.ndarray) -> np.ndarray:
        may = self.screen(v)
        best = may.argmax(axis=1)
        several = np.flatnonzero(may.sum(axis=1) > 1)
        if len(several):
            rows, which = np.nonzero(may[several])  # by vector, then number
            d = self.exact(v[several[rows]], which)
            # of equal distances the first stays: the sort is stable and numbers rise
            order = np.lexsort((d, rows)) if d.dtype != object else np.array(sorted(range(len(d)), key=lambda i: (rows[i], d[i])))
            first = np.concatenate([[True], rows[order][1:] != rows[order][:-1]])
            best[several] = which[order][first]
        return best


def exact_sums(v: np.ndarray) -> list[int]:
    """Sums of each column, as Python's integers."""
    if np.abs(v).max(initial=0.0) * len(v) < 2.0**62:
        return v.astype(np.int64).sum(axis=0).tolist()
    return [sum(map(int, c)) for c in v.T]


def limbs(x: int) -> Iterator[tuple[int, int]]:
    """(i, part) with x the sum of part << 32 i; parts have x's sign and are within 32 bits."""
    sign, x, i = (-1 if x < 0 else 1), abs(x), 0
    while x:
        if part := x & (1 << LIMB) - 1:
            yield i, sign * part
        x, i = x >> LIMB, i + 1


def starts(vectors: DataFrame, k: int, dims: int, seed: str) -> list[list[int]]:
    """The k vectors of the smallest sha256 of seed:id, in its order; of equal ids in the order of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[float]]] = []
        for batch in batches:
            ids, v = kept(batch, dims)
            found = [(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), j) for j, i in enumerate(ids.to_pylist()) if i is not None]
            found.sort(key=lambda x: x[0])
            bar = found[k - 1][0] if len(found) >= k else "~"
            best = sorted(best + [(h, v[j].tolist()) for h, j in found if h <= bar])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([x for _, x in best], pa.list_(pa.float64()))], names=["hash", "v"])

    rows = vectors.mapInArrow(run, "hash string, v array<double>").orderBy("hash", "v").limit(k).collect()
    return [[int(x) for x in r.v] for r in rows]


def totals(vectors: DataFrame, centroids: Centroids, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that has any: number and sums of its vectors. At most k times dims and a few parts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [0] * len(centroids.rows)
        sums = [[0] * dims for _ in counts]
        for batch in batches:
            _, vs = kept(batch, dims)
            for at in range(0, len(vs), CHUNK):
                v = vs[at : at + CHUNK]
                best = centroids.nearest(v)
                order = np.argsort(best, kind="stable")
                found, begin = np.unique(best[order], return_index=True)
                for c, part in zip(found.tolist(), np.split(order, begin[1:]), strict=True):
                    counts[c] += len(part)
                    sums[c] = [a + b for a, b in zip(sums[c], exact_sums(v[part]), strict=True)]
        rows = [(c, -1, 0, n) for c, n in enumerate(counts) if n]
        rows += [(c, d, i, x) for c, n in enumerate(counts) if n for d, s in enumerate(sums[c]) for i, x in limbs(s)]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "dim", "limb", "part"])

    parts = vectors.mapInArrow(run, "cluster int, dim int, limb int, part long")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cluster", "dim", "limb").agg(F.sum("part").alias("part")).collect():
        n, sums = out.setdefault(r.cluster, (0, [0] * dims))
        if r.dim < 0:
            out[r.cluster] = (r.part, sums)
        else:
            sums[r.dim] += r.part << LIMB * r.limb
    return out


def fit(vectors: DataFrame, k: int = K, dims: int = DIMS, rounds: int = ROUNDS, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> list[list[int]]:
    """The centroids after so many rounds; none of a table without vectors."""
    _base.ship(vectors.sparkSession)
    frame = vectors.select(F.col(f"`{id_col}`"), F.col(f"`{vector_col}`"))
    rows = starts(frame, k, dims, seed)
    for _ in range(rounds if rows else 0):
        for c, (n, sums) in totals(frame, Centroids(rows), dims).items():
            rows[c] = [s // n for s in sums]
    return rows


def assign(vectors: DataFrame, rows: list[list[int]], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance of each vector that takes part."""
    _base.ship(vectors.sparkSession)
    frame = vectors.select(F.col(f"`{id_col}`"), F.col(f"`{vector_col}`"))
    schema = T.StructType([frame.schema[0], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not rows:
        return frame.sparkSession.createDataFrame([], schema)
    centroids = Centroids(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vs = kept(batch, len(rows[0]))
            for at in range(0, len(vs), CHUNK):
                v = vs[at : at + CHUNK]
                best = centroids.nearest(v)
                d = centroids.exact(v, best)
                if d.dtype == object:
                    d = np.array([min(x, LONGEST) for x in d], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(v)), pa.array(best, pa.int32()), pa.array(d, pa.int64())], names=schema.names)

    return frame.mapInArrow(run, schema)


def cluster(vectors: DataFrame, k: int = K, dims: int = DIMS, rounds: int = ROUNDS, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector that takes part: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    rows = fit(vectors, k, dims, rounds, seed, id_col, vector_col)
    found = _base.materialize(assign(vectors, rows, id_col, vector_col), "clusters")
    by = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows at most
    each, whole = {r.cluster: min(int(r.d), LONGEST) for r in by}, min(sum(int(r.d) for r in by), LONGEST)
    digests = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in rows]
    told = spark.createDataFrame([(c, d, whole, digests[c]) for c, d in sorted(each.items())], "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), F.col("cluster") == F.col("of")).drop("of")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(_base.read(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds one after another, each nearest centroid by all distances."""
    steps = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
)""",
        """c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INT) AS c, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT 40)
)""",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)) AS d,
    CAST(arg_min(c, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS HUGEINT) * 64 + c) AS INT) AS c
  FROM v CROSS JOIN c{i} c GROUP BY r
)""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (
  SELECT c, list(m ORDER BY d) AS x FROM (
    SELECT c, d, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m
    FROM (SELECT a.c, t.k AS d, sum(v.x[t.k]) AS s, count(*) AS n FROM a{i} a JOIN v USING (r), range(1, 65) t(k) GROUP BY a.c, t.k)
  ) GROUP BY c
)""")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c)")
    return f"""
WITH {", ".join(steps)}
SELECT v.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN c{ROUNDS} c ON c.c = a.c
"""


ORACLE = _oracle()
