"""Embedding whitening: covariance in double-double by error-free transformations, and a tridiagonal divide-and-conquer eigen-solve.

A component becomes the long x = floor(256 c). The fit list is each distinct x vector once: packed into bytes, made distinct by an aggregate that first works within tasks, and written.
Its number n and sums S are whole numbers, so the mean is known exactly and a vector is centred before anything is multiplied, as x - S/n in double-double.

**Covariance.** For a block of ``ROWS`` centred vectors each column is cut, without error, into three slices of ``BITS`` bits below the column's largest entry and a rest. A matrix product of
slices adds whole multiples of one unit that stay within 2**53, so it is exact in doubles in whatever order it is summed; the products are added to a high part by
TwoSum, whose errors go to a low part. The rest (below 2**-60 of the column) is multiplied in plain doubles. Each task sends one high and low part, in bands of rows;
tasks' parts are merged by TwoSum, ``FAN`` at a time in the order of the tasks, level by level, so no task or driver meets more than ``FAN`` of them.

**Eigen-solve.** On the driver, of a matrix of dims**2 numbers: LAPACK's symmetric driver that numpy calls (reduction to tridiagonal form, divide and conquer), then two steps of
quadratic refinement in extended precision against the high and low part, so that close eigenvalues cost no digits.

Defined cases: vectors null, empty, or with null or non-finite components take no part; a product beyond a long is the nearest long. Lengths may differ: the commonest among distinct vectors
(of equals, the shortest) is used, and other vectors take no part, unless ``dims`` names a length. Rows with a null id and repeated rows have their rows. There are as many components as asked for, at most dims. A component without variance
(at most dims * 2**-52 of the largest) has null ``whitened`` and is left out of ``identity_error``; without any variance ``explained`` and ``identity_error`` are null too. A deviation beyond a long is the largest long.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm import _base
from curata.llm.centroids import limbs
from curata.llm.topk import LONGEST

COMPONENTS = 4
ROWS, BITS = 1024, 22
FAN = 16
BAND_BYTES = 1 << 20
PARTS = "part long, band int, hi binary, lo binary"


def to_longs(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = np.floor(256.0 * values)
    inside = np.abs(v) < 2.0**63
    return np.where(inside, np.where(inside, v, 0).astype(np.int64), np.where(v > 0, LONGEST, -LONGEST - 1))


def valid(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors as longs of the rows that take part, for each length."""
    ids, lists = batch.column(0), batch.column(1)
    offsets = lists.offsets.to_numpy()
    sizes = np.where(np.asarray(lists.is_valid()), np.diff(offsets), 0)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        v = values[offsets[at][:, None] + np.arange(n)]
        good = np.isfinite(v).all(axis=1)
        if good.any():
            yield ids.take(pa.array(at[good])), to_longs(v[good])


def pack(v: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest of 16, 32 and 64 bits that holds it; equal vectors, equal bytes."""
    most = np.maximum(v.max(axis=1), -(v.min(axis=1) + 1))
    width = np.where(most < 2**15, 2, np.where(most < 2**31, 4, 8))
    out: list[bytes] = [b""] * len(v)
    for w in (2, 4, 8):
        for i, row in zip(np.flatnonzero(width == w).tolist(), v[width == w].astype(f"<i{w}"), strict=True):
            out[i] = bytes([w]) + row.tobytes()
    return out


def unpack(packed: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(packed), dims), dtype=np.int64)
    widths = np.array([p[0] for p in packed])
    for w in (2, 4, 8):
        at = np.flatnonzero(widths == w)
        if len(at):
            out[at] = np.frombuffer(b"".join(packed[i][1:] for i in at), dtype=f"<i{w}").reshape(len(at), dims)
    return out


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield unpack(batch.column(0).slice(at, ROWS).to_pylist(), dims)


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


class Mean:
    """The exact mean S/n, and vectors less it in double-double."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        exact = [Fraction(s, n) for s in sums]
        self.hi = np.array([float(m) for m in exact])
        self.lo = np.array([float(m - Fraction(float(m))) for m in exact])
        self.most = max(map(abs, sums))

    def centred(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if max(int(v.max(initial=0)), -int(v.min(initial=0))) < 2**53:
            s, e = two_sum(v.astype(np.float64), -self.hi)
            hi = s + (e - self.lo)
            return hi, (s - hi) + (e - self.lo)
        exact = [[Fraction(int(x) * self.n - s, self.n) for x, s in zip(row, self.sums, strict=True)] for row in v]
        hi = np.array([[float(x) for x in row] for row in exact])
        return hi, np.array([[float(x - Fraction(h)) for x, h in zip(a, b, strict=True)] for a, b in zip(exact, hi.tolist(), strict=True)])

    def deviations(self, v: np.ndarray) -> np.ndarray:
        """Sums over dimensions of (n x - S)^2, exact, at most the largest long."""
        n, most = self.n, max(int(v.max(initial=0)), -int(v.min(initial=0)))
        about = v.astype(np.float64) * n - np.array([float(s) for s in self.sums])
        err = 2.0**-50 * (float(most) * n + float(self.most))
        least = (np.maximum(np.abs(about) - err, 0) ** 2).sum(axis=1) * (1 - 1e-9)
        out = np.full(len(v), LONGEST, dtype=np.int64)
        fits = np.zeros(len(v), dtype=bool)
        if n * most + self.most < 2**62:
            fits = ((np.abs(about) + err) ** 2).sum(axis=1) < 2.0**62
            d = v[fits] * n - np.array(self.sums, dtype=np.int64)
            out[fits] = (d * d).sum(axis=1)
        for i in np.flatnonzero(~fits & (least < 2.0**63)):
            out[i] = min(LONGEST, sum((int(x) * n - s) ** 2 for x, s in zip(v[i], self.sums, strict=True)))
        return out


def slices(hi: np.ndarray, lo: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Three slices of BITS bits a column, and the rest; their sum is hi + lo."""
    exponent = np.frexp(np.abs(hi).max(axis=0, initial=0.0))[1]
    cut, rest = [], hi
    for i in range(3):
        # adding and taking away 1.5 * 2**k rounds to multiples of 2**(k - 52)
        big = np.ldexp(1.5, exponent - i * BITS + 53 - BITS)
        part = (rest + big) - big
        cut.append(part)
        rest = rest - part
    return cut, rest + lo


class Gram:
    """Sum of outer products of double-double vectors, in double-double."""

    def __init__(self, dims: int) -> None:
        self.hi, self.lo = np.zeros((dims, dims)), np.zeros((dims, dims))

    def add(self, hi: np.ndarray, lo: np.ndarray | None = None) -> None:
        """At most ROWS vectors: 2 (BITS - 1) bits and their number stay within 53."""
        cut, rest = slices(hi, np.zeros_like(hi) if lo is None else lo)
        terms = []
        for i, a in enumerate(cut):
            terms.append(a.T @ a)
            for b in cut[i + 1 :]:
                terms += [p := a.T @ b, p.T]
        self.lo += (small := rest.T @ hi) + small.T
        for t in terms:
            self.hi, e = two_sum(self.hi, t)
            self.lo += e
        self.hi, self.lo = two_sum(self.hi, self.lo)

    def rows(self, part: int) -> pa.RecordBatch:
        """Its bands; as a row or more of PARTS."""
        step = max(1, BAND_BYTES // (8 * len(self.hi)))
        bands = range(0, len(self.hi), step)
        cut = lambda m: pa.array([m[b : b + step].astype("<f8").tobytes() for b in bands], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([part] * len(bands), pa.int64()), pa.array(bands, pa.int32()), cut(self.hi), cut(self.lo)], names=["part", "band", "hi", "lo"])


def merged(parts: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """High and low part of the sum of all tasks' parts."""

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        hi = lo = np.zeros(len(group["hi"][0].as_py()) // 8)
        for h, l in zip(group["hi"].to_pylist(), group["lo"].to_pylist(), strict=True):  # noqa: E741
            hi, e = two_sum(hi, np.frombuffer(h, "<f8"))
            hi, lo = two_sum(hi, lo + (np.frombuffer(l, "<f8") + e))
        return pa.table([[group["to"][0].as_py()], [group["band"][0].as_py()], [hi.astype("<f8").tobytes()], [lo.astype("<f8").tobytes()]], schema=made)

    made = pa.schema([("part", pa.int64()), ("band", pa.int32()), ("hi", pa.binary()), ("lo", pa.binary())])
    parts = _base.materialize(parts, "covariance")
    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while n > 1:
        parts = parts.withColumn("to", F.floor(F.col("part") / FAN).cast("long")).groupBy("to", "band").applyInArrow(merge, PARTS)
        n = -(-n // FAN)
    got = sorted(parts.collect(), key=lambda r: r.band)  # bands of one matrix
    return tuple(np.frombuffer(b"".join(r[c] for r in got), "<f8").reshape(-1, dims) for c in ("hi", "lo"))


def gram(fit: DataFrame, dims: int, width: int, make) -> tuple[np.ndarray, np.ndarray]:
    """The sum of outer products of make(x vectors), rows of ``width`` numbers in one part or two, over the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Gram(width)
        for v in blocks(batches, dims):
            g.add(*make(v))
        yield g.rows(TaskContext.get().partitionId())

    return merged(fit.mapInArrow(run, PARTS), width)


def sums(fit: DataFrame, dims: int) -> Mean:
    """n and S; the driver gets a few numbers a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for v in blocks(batches, dims):
            n += len(v)
            high, low = (v >> 32).sum(axis=0).tolist(), (v & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + w for t, h, w in zip(total, high, low, strict=True)]
        rows = [(-1, 0, n)] + [(d, i, x) for d, t in enumerate(total) for i, x in limbs(t)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["dim", "limb", "part"])

    n, total = 0, [0] * dims
    for r in fit.mapInArrow(run, "dim int, limb int, part long").groupBy("dim", "limb").agg(F.sum("part").alias("part")).collect():
        if r.dim < 0:
            n = r.part
        else:
            total[r.dim] += r.part << 32 * r.limb
    return Mean(n, total)


def eigen(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors, as columns, of the symmetric matrix hi + lo; an eigenvector's largest entry is positive."""
    scale = float(np.abs(hi).max(initial=0.0))
    if not scale:
        return np.zeros(len(hi)), np.eye(len(hi))
    a = (hi.astype(np.longdouble) + lo.astype(np.longdouble)) / scale
    a = (a + a.T) / 2
    x = np.linalg.eigh(a.astype(np.float64))[1].astype(np.longdouble)
    for _ in range(2):
        r = np.eye(len(a), dtype=np.longdouble) - x.T @ x
        s = x.T @ a @ x
        e = np.diag(s) / (1 - np.diag(r))
        near = 2 * (np.abs(s - np.diag(e)).sum(axis=1).max() + np.abs(r).sum(axis=1).max())
        gap = e[None, :] - e[:, None]
        apart = np.abs(gap) > near
        turn = np.where(apart, (s + e[None, :] * r) / np.where(apart, gap, 1), 0)
        x = x + x @ (r / 2 + (turn - turn.T) / 2)  # the step's symmetric part is r / 2; a small gap must not blur it
    x = x / np.sqrt((x * x).sum(axis=0))
    e = np.maximum((x * (a @ x)).sum(axis=0), 0)
    order = np.argsort(-e, kind="stable")
    x = x[:, order]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(x))] < 0, -1, 1)
    return (e[order] * scale).astype(np.float64), x.astype(np.float64)


class Whitening:
    """What a fit has found, and what it makes of vectors."""

    def __init__(self, dims: int, mean: Mean, hi: np.ndarray, lo: np.ndarray, components: int) -> None:
        self.dims, self.mean = dims, mean
        values, vectors = eigen(hi, lo)
        self.values, self.vectors = values[:components] / mean.n, vectors[:, :components]
        self.trace = float(np.trace(hi) + np.trace(lo)) / mean.n
        self.varies = values[:components] > values[:1] * dims * 2.0**-52
        self.to = self.vectors / np.sqrt(np.where(self.varies, self.values, 1))
        self.identity_error: float | None = None

    def project(self, v: np.ndarray) -> np.ndarray:
        return self.mean.centred(v)[0] @ self.to


def fit_list(vectors: DataFrame, vector_col: str) -> DataFrame:
    """x, dims: each distinct vector once, packed; written."""
    _base.ship(vectors.sparkSession)
    frame = vectors.select(F.lit(0).alias("id"), F.col(f"`{vector_col}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, v in valid(batch):
                yield pa.RecordBatch.from_arrays([pa.array(pack(v), pa.binary()), pa.array(np.full(len(v), v.shape[1]), pa.int32())], names=["x", "dims"])

    return _base.materialize(frame.mapInArrow(run, "x binary, dims int").distinct(), "fit")


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, dims: int | None = None) -> Whitening | None:
    """None where no vector takes part."""
    rows = fit_list(vectors, vector_col)
    if dims is None:
        commonest = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
        if commonest is None:
            return None
        dims = commonest.dims
    rows = rows.where(F.col("dims") == dims).select("x")
    mean = sums(rows, dims) if not rows.isEmpty() else None
    if mean is None:
        return None
    found = Whitening(dims, mean, *gram(rows, dims, dims, mean.centred), components)
    if found.varies.any():
        one = lambda v: (np.hstack([found.project(v), np.ones((len(v), 1))]),)
        k = len(found.values)
        g = np.add(*gram(rows, dims, k + 1, one)) / mean.n
        covariance = g[:k, :k] - np.outer(g[:k, k], g[:k, k])
        found.identity_error = float(np.abs(covariance - np.eye(k))[np.ix_(found.varies, found.varies)].max())
    return found


WHITENED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, dims: int | None = None) -> DataFrame:
    """One row for each vector that takes part and component: id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, vector_col, components, dims)
    frame = vectors.select(F.col(f"`{id_col}`"), F.col(f"`{vector_col}`"))
    schema = T.StructType([frame.schema[0], *T._parse_datatype_string(WHITENED).fields])
    if model is None:
        return frame.sparkSession.createDataFrame([], schema)
    k = len(model.values)
    share = [e / model.trace if model.trace else None for e in model.values.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vs in valid(batch):
                for at in range(0, len(vs) if vs.shape[1] == model.dims else 0, ROWS):
                    v = vs[at : at + ROWS]
                    m = len(v)
                    w = np.where(model.varies, model.project(v), np.nan).ravel()
                    cols = [
                        ids.slice(at, m).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        pa.array(np.full(m * k, model.mean.n), pa.int64()),
                        pa.array(np.repeat(model.mean.deviations(v), k), pa.int64()),
                        pa.array(w, pa.float64(), from_pandas=True),
                        pa.array(share * m, pa.float64()),
                        pa.array([model.identity_error] * (m * k), pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return frame.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_base.read(spark, sf_dir, "embeddings"))
