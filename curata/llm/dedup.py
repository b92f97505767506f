"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation, components by stars.

1. Each text's shingles become 64-bit hashes; a document's row gets the set's size, a 128-bit digest of the set and the hashes of ``BANDS`` bands of
   ``ROWS`` minima. Documents of equal sets are one class, named by its smallest id; from here on classes count, not copies.
2. Classes that share a band's bucket are candidates. In a first round each member of a bucket meets two pivots, the bucket's smallest and
   largest class: pairs in number of the members. Pairs whose signatures agree too little (six standard deviations below the
   threshold) go, the rest is confirmed on the full sets, and components follow.
3. The second round takes only buckets that still hold several components. In small ones (``SMALL`` members) all pairs across
   components follow the same way. In large ones the classes outside the bucket's commonest component (the strays) meet all
   members, once for all buckets of that component, in blocks of ``SIDE`` against ``SIDE``, or fewer where the sets of so many pass ``SIDE_BYTES``, inside Python: sets are intersected
   exactly, and only links that join two components come out. So no link between components is lost, and no group is gathered
   whole or turned into rows of pairs. Cost: strays times members, shared out over blocks.

With b bands of r rows a pair of similarity s is missed with probability (1 - s^r)^b: 6e-11 at 0.85 and 5e-8 at 0.8.

Defined cases: a text without words (or null) has the empty set and is linked with nothing; one with fewer words than a shingle has its whole
sequence as one; rows of one id are one document, their links pooled; rows without id take no part, have no component and are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import _base
from curata.operators.identity import stars

BANDS, ROWS = 32, 4
SMALL = 64
SIDE = 256
SIDE_BYTES = 16 << 20
WORDS_KEPT = 50_000
#: So many ids at most are broadcast (some 50 MB in an executor); beyond, the join is by a shuffle.
BROADCAST_IDS = 1_000_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Text -> sorted distinct 64-bit shingle hashes. Words: runs without ASCII white space, A-Z lower-cased."""

    def __init__(self, size: int) -> None:
        self.size, self.words = size, _WordHashes()
        r = np.random.default_rng(20240501)
        self.odd = r.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.by_length = r.integers(0, 2**63, size + 1, dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        k = min(self.size, len(h))
        n = len(h) - k + 1
        g = np.full(n, self.by_length[k])
        for i in range(k):
            g += h[i : i + n] * self.odd[i]
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        return np.unique(g)


class MinHash:
    """Minima of BANDS * ROWS universal hashes (multiply, add, upper 32 bits)."""

    def __init__(self) -> None:
        r = np.random.default_rng(20240502)
        self.a = (r.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.b = r.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)[:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(BANDS * ROWS, 2**32 - 1, dtype=np.uint64)
        for at in range(0, len(shingles), 1024):
            np.minimum(out, ((self.a * shingles[None, at : at + 1024] + self.b) >> np.uint64(32)).min(axis=1), out=out)
        return out.astype(np.uint32)


class Fingerprinter:
    def __init__(self, size: int) -> None:
        self.shingles, self.minima = Shingler(size), MinHash()

    def __call__(self, text: str | None) -> tuple:
        s = self.shingles(text)
        if not len(s):
            return (0, None, None, None)
        signature = self.minima(s).reshape(BANDS, ROWS)
        bands = [xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) - 2**63 for i, row in enumerate(signature)]
        digest = xxhash.xxh3_128_digest(s.tobytes())
        return (len(s), int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), bands)


class SetMaker(Fingerprinter):
    def __call__(self, text: str | None) -> tuple:
        s = self.shingles(text)
        return (len(s), self.minima(s).tobytes(), s.tobytes())


def enough(inter: int | np.ndarray, a: int | np.ndarray, b: int | np.ndarray, percent: int) -> bool | np.ndarray:
    """100 * intersection >= percent * union, in whole numbers."""
    return 100 * inter >= percent * (a + b - inter)


def only_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """docs whose id is (left_semi) or is not (left_anti) among ids; the ids are broadcast if they are few, by their counted number."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def _filter_pairs(pairs: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                good = pa.array(keep(b))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that are links: first by signature, then on the full sets."""
    t = percent / 100
    least = math.floor(BANDS * ROWS * (t - 6 * math.sqrt(t * (1 - t) / (BANDS * ROWS))))

    def alike(b: pa.RecordBatch) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint32).reshape(b.num_rows, -1) for i in (2, 3))
        n, m = b.column(4).to_numpy(), b.column(5).to_numpy()
        return ((x == y).sum(axis=1) >= least) & enough(np.minimum(n, m), n, m, percent)

    def linked(b: pa.RecordBatch) -> np.ndarray:
        out = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            out.append(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
        return np.array(out, dtype=bool)

    side = lambda c, what: sets.select(F.col("node").alias(c), *[F.col(w).alias(f"{w}_{c}") for w in what])
    signed = pairs.join(side("a", ["sig", "n"]), "a").join(side("b", ["sig", "n"]), "b").select("a", "b", "sig_a", "sig_b", "n_a", "n_b")
    near = _base.materialize(_filter_pairs(signed, alike), "near")
    whole = near.join(side("a", ["set"]), "a").join(side("b", ["set"]), "b").select("a", "b", "set_a", "set_b")
    return _base.materialize(_filter_pairs(whole, linked), "links")


def _links_of_block(strays: list[tuple], members: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between a block's strays and members (node, root, set) that join two components; fewer than there are components."""
    out: list[tuple[int, int]] = []
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    if not strays or not members:
        return out
    sets = [np.frombuffer(x[2], dtype=np.uint64) for x in (*members, *strays)]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    vocabulary, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    k = len(members)
    flat, ends = at[: starts[k]], starts[:k]
    roots = np.array([x[1] for x in members], dtype=np.int64)
    here = np.zeros(len(vocabulary), dtype=np.int64)
    for j, (node, root, _) in enumerate(strays, k):
        mine = at[starts[j] : starts[j] + sizes[j]]
        here[mine] = 1
        inter = np.add.reduceat(here[flat], ends)
        here[mine] = 0
        for i in np.flatnonzero(enough(inter, sizes[:k], sizes[j], percent) & (roots != root)):
            p, q = find(root), find(int(roots[i]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((node, members[i][0]))
    return out


def _block_links(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by block (main, mb, sb, stray, node, root, set): one block in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def close() -> pa.RecordBatch:
            links = _links_of_block(sides[1], sides[0], percent)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            for main, mb, sb, stray, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (main, mb, sb) != now:
                    yield close()
                    now, sides = (main, mb, sb), ([], [])
                sides[stray].append(tuple(row))
        yield close()

    return run


def stray_links(hot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components in large buckets. hot: bucket, node, root."""
    common = hot.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    sizes = sets.groupBy("node").agg(F.max("n").alias("n"))
    met = hot.join(_base.materialize(common, "common"), "bucket").select("main", "node", "root").distinct()
    met = _base.materialize(met.join(sizes, "node").select("main", "node", "root", (F.col("n") * 8).alias("bytes")), "met")
    stray = F.col("root") != F.col("main")
    counts = met.groupBy("main").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.count_if(stray).alias("n_strays"), F.sum(F.when(stray, F.col("bytes"))).alias("b_strays"))
    blocks = lambda n, b: F.ceil(F.greatest(F.col(n) / SIDE, F.col(b) / SIDE_BYTES)).cast("int")
    counts = _base.materialize(counts.where("n_strays > 0").select("main", blocks("n", "b").alias("m_blocks"), blocks("n_strays", "b_strays").alias("s_blocks")), "blocks")
    rows = met.join(counts, "main").withColumn("h", F.xxhash64("node"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    members = rows.select("main", "node", "root", F.pmod("h", "m_blocks").cast("int").alias("mb"), each("s_blocks").alias("sb"), F.lit(False).alias("stray"))
    strays = rows.where("root <> main").select("main", "node", "root", each("m_blocks").alias("mb"), F.pmod("h", "s_blocks").cast("int").alias("sb"), F.lit(True).alias("stray"))
    dealt = members.unionByName(strays).join(sets.select("node", "set"), "node").select("main", "mb", "sb", "stray", "node", "root", "set")
    block = ["main", "mb", "sb"]
    return _base.materialize(dealt.repartition(*block).sortWithinPartitions(*block).mapInArrow(_block_links(percent), "a long, b long").distinct(), "stray_links")


def near_duplicates(docs: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links of 100 * intersection >= percent * union) and kept, one row for each row of docs."""
    _base.ship(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    prints = _base.materialize(_base.map_texts(d, lambda: Fingerprinter(size), "n_shingles long, k1 long, k2 long, bands array<long>", ["doc_id"]), "prints")
    full = prints.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = _base.materialize(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "classes")
    rows = _base.materialize(prints.select("doc_id", "n_shingles", "k1", "k2").join(classes.select("k1", "k2", "node"), ["k1", "k2"], "left").select("doc_id", "n_shingles", "node"), "rows")

    in_bands = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = in_bands.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    shared = _base.materialize(in_bands.join(_base.materialize(buckets, "buckets"), "bucket"), "shared")
    n = shared.count()
    candidates = _base.materialize(shared.select(F.col("node").alias("doc_id")).distinct(), "candidates", n)
    made = _base.map_texts(only_ids(d, candidates), lambda: SetMaker(size), "n long, sig binary, `set` binary", ["doc_id"])
    sets = _base.materialize(made.where("n > 0").withColumnRenamed("doc_id", "node"), "sets")
    if sets.count() > candidates.count():  # rows of one id; equal ones count once
        sets = _base.materialize(sets.dropDuplicates(["node", "set"]), "sets")

    pivots = shared.select(F.col("low").alias("a"), F.col("node").alias("b")).unionByName(shared.select(F.col("node").alias("a"), F.col("high").alias("b")))
    pivots = _base.materialize(pivots.where("a < b").distinct(), "pivots", 2 * n)
    links = verify(pivots, sets, percent)
    first = stars(links, "a", "b")

    named = shared.select("bucket", "node").join(first, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    named = _base.materialize(named, "named", n)
    mixed = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket", "m")
    left = _base.materialize(named.join(_base.materialize(mixed, "mixed", n), "bucket"), "left", n)
    small = left.where(F.col("m") <= SMALL).groupBy("bucket").agg(F.collect_list(F.struct("node", "root")).alias("xs"))
    one = small.select("xs", F.explode("xs").alias("x"))
    two = one.select("x", F.explode(F.filter("xs", lambda y: (y["node"] > F.col("x.node")) & (y["root"] != F.col("x.root")))).alias("y"))
    pairs = _base.materialize(two.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(pivots, ["a", "b"], "left_anti"), "pairs")
    more = verify(pairs, sets, percent)
    hot = left.where(F.col("m") > SMALL).select("bucket", "node", "root")
    found = first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    if not hot.isEmpty():
        found = found.unionByName(stray_links(hot, sets, percent))
    # rows of one id with different texts
    same = rows.where("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = _base.materialize(same, "same").where("a <> b")
    if not same.isEmpty():
        found = found.unionByName(rows.join(same.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).distinct())
    last = stars(found, "a", "b")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("root", "node", "doc_id"))
    return rows.join(last, "node", "left").select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicates, that of the smallest id; columns as they were."""
    found = _base.materialize(near_duplicates(docs, size, percent, id_col, text_col), "near_duplicates")
    gone = found.where("NOT kept").select("doc_id").distinct()
    key = F.col(f"`{id_col}`").cast("long")
    kept = docs.join(F.broadcast(gone.withColumnRenamed("doc_id", "__gone")) if gone.count() <= BROADCAST_IDS else gone.withColumnRenamed("doc_id", "__gone"), key == F.col("__gone"), "left_anti")
    repeated = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():  # one row of several of one id
        kept = kept.where(key.isNull()).unionByName(kept.where(key.isNotNull()).dropDuplicates([id_col]))
    return kept


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_base.read(spark, sf_dir, "documents"), size=3, percent=85)
