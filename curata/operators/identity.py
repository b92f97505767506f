"""Who owns a key first, repeated ids and hashes, groups in two splits, order-free fingerprints, near-duplicate bit patterns, components.

First owners come from an aggregate (map-side combined) joined back, not from a window over the key: a hot key is
then a skewed join, which adaptive execution splits, and not one task that sorts all its rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.functions.absence import SENTINELS
from curata.plans.storage import BROADCAST_ROWS, materialize, ship


def first_owners(df: DataFrame, key: str, index: str, columns: Sequence[str]) -> DataFrame:
    """key, first_index and first_<column> of the row of lowest index for each key; null keys have no owner."""
    first = F.min(F.struct(index, *columns))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(first.alias("f")).select(key, F.col(f"f.{index}").alias("first_index"), *[F.col(f"f.{c}").alias(f"first_{c}") for c in columns])


def duplicate_findings(df: DataFrame, index: str, item: str, group: str, content_hash: str) -> DataFrame:
    """R4: the hash's first owner is another group (later rows of any other group as well); E5: it is the same group."""
    ok = df.where(F.col(content_hash).isNotNull() & ~F.col(content_hash).isin(*SENTINELS) & F.col(group).isNotNull())
    joined = ok.join(first_owners(ok, content_hash, index, [group, item]), content_hash).where(F.col(index) > F.col("first_index"))
    leak = F.col(group) != F.col(f"first_{group}")
    return joined.select(
        F.when(leak, "R4").otherwise("E5").alias("rule"), F.when(leak, "error").otherwise("warning").alias("severity"), F.col(index).alias("record_index"),
        F.col(item).alias("item"), F.col(group).alias("grp"), F.col(f"first_{item}").alias("first_item"), F.col(f"first_{group}").alias("first_grp"),
    )


def repeated_ids(df: DataFrame, index: str, item: str) -> DataFrame:
    """R1: every row of an id after its first."""
    return df.join(first_owners(df, item, index, []), item).where(F.col(index) > F.col("first_index")).select(F.lit("R1").alias("rule"), F.col(index).alias("record_index"), F.col(item).alias("item"), "first_index")


def split_conflicts(df: DataFrame, index: str, group: str, split: str) -> DataFrame:
    """R3: one row for each group in several splits; record_index is the smallest of the splits' last rows."""
    last = df.where(F.col(group).isNotNull() & F.col(split).isNotNull()).groupBy(group, split).agg(F.max(index).alias("i"))
    found = last.groupBy(group).agg(F.count(F.lit(1)).alias("n_splits"), F.min("i").alias("record_index"), F.array_join(F.array_sort(F.collect_list(split)), ",").alias("splits"))
    return found.where("n_splits > 1").select(F.lit("R3").alias("rule"), F.col(group).alias("grp"), "n_splits", "record_index", "splits")


def canonical(columns: Sequence[str]) -> Column:
    """Name-sorted JSON of columns, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


#: Hexadecimal digits of an id's digest that name its bucket, level by level.
LEVELS = (6, 3, 0)


def fingerprint(df: DataFrame, id_col: str, row: Column, header: str) -> DataFrame:
    """One digest of all rows in the order of (bucket, id, row), whatever order they come in.

    A digest a row, then one for each of 16 million buckets of ids, one for each 4,096 of those, one over the last 4,096: some thousands of digests in a task's group at 10**10 rows.
    """
    rows = df.select(F.col(id_col).alias("key"), F.sha2(row, 256).alias("h")).withColumn("b", F.substring(F.sha2(F.coalesce(F.col("key").cast("string"), F.lit("")), 256), 1, LEVELS[0]))
    ordered = lambda xs: F.array_join(F.transform(F.array_sort(xs), lambda x: x["h"]), "")
    rows = rows.select("b", "key", "h", F.lit(1).cast("long").alias("n"))
    for digits in LEVELS[1:]:
        rows = rows.groupBy("b").agg(F.sha2(ordered(F.collect_list(F.struct("key", "h"))), 256).alias("h"), F.sum("n").alias("n"))
        rows = rows.select(F.substring("b", 1, digits).alias("b"), F.col("b").alias("key"), "h", "n")
    whole = ordered(F.collect_list(F.struct("key", "h")))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.sha2(F.concat(F.lit(header), whole), 256).alias("fingerprint"))


def simhash(df: DataFrame, keep: Sequence[str], text: str, size: int = 3) -> DataFrame:
    """The columns ``keep`` and ``bits``: the majority of the first 64 bits of the md5 of a text's distinct shingles, words split at spaces; null for a text without words. One pass, no shuffle."""
    ship(df.sparkSession)
    rows = df.select(*keep, F.col(text).alias("__text"))
    names = [*rows.columns[:-1], "bits"]

    def bits(t: str | None) -> int | None:
        words = [w for w in (t or "").split(" ") if w]
        if not words:
            return None
        shingles = {" ".join(words[i : i + size]) for i in range(max(len(words) - size, 0) + 1)}
        ones = np.unpackbits(np.frombuffer(b"".join(hashlib.md5(x.encode()).digest()[:8] for x in shingles), dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([bits(t.as_py()) for t in b.columns[-1]], pa.int64())], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("bits", T.LongType())]))


class Passages:
    """Passages of some words, numbered, and which of them a text holds: words become numbers, windows of them a hash, and what the hash finds is compared word by word."""

    def __init__(self, passages: Sequence[str]) -> None:
        self.words: dict[str, int] = {}
        self.rows = np.array([[self.words.setdefault(w, len(self.words) + 1) for w in p.split(" ")] for p in passages], dtype=np.uint64)
        self.size = self.rows.shape[1]
        self.odd = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(self.size)], dtype=np.uint64)
        hashes = (self.rows * self.odd).sum(axis=1, dtype=np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def found(self, text: str | None) -> list[int]:
        get = self.words.get
        ids = np.array([get(w, 0) for w in (text or "").split(" ")], dtype=np.uint64)
        n = len(ids) - self.size + 1
        if n < 1:
            return []
        windows = np.lib.stride_tricks.sliding_window_view(ids, self.size)
        hashes = np.zeros(n, dtype=np.uint64)
        for i in range(self.size):
            hashes += ids[i : i + n] * self.odd[i]
        first = np.searchsorted(self.hashes, hashes)
        out, at = set(), np.flatnonzero((first < len(self.hashes)) & (self.hashes[np.minimum(first, len(self.hashes) - 1)] == hashes))
        while len(at):
            number = self.order[first[at]]
            out.update(number[(self.rows[number] == windows[at]).all(axis=1)].tolist())
            first[at] += 1  # other passages of the same hash
            at = at[(first[at] < len(self.hashes))]
            at = at[self.hashes[first[at]] == hashes[at]]
        return sorted(out)


def shared_passages(df: DataFrame, item: str, text: str, marked: DataFrame, mark: str, size: int = 8, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """mark, item, n_shared: how many different passages of ``size`` words, split at spaces, a text shares with a marked one (marked: mark and the same text column).

    The marked passages are counted. Few are broadcast, numbered, and each text is read once: no passage of it is made into a row but those that hit. Many are met by a join on the passages of both sides.
    """

    def each(t: DataFrame, i: str) -> DataFrame:
        w = t.select(F.col(i).alias(i), F.split(text, " ").alias("__w")).where(F.size("__w") >= size)
        return w.select(i, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("__w") - size + 1), lambda k: F.array_join(F.slice("__w", k, size), " ")))).alias("__s"))

    spark = df.sparkSession
    ship(spark)
    own = materialize(each(marked, mark), "passages")
    distinct = own.select("__s").distinct().limit(broadcast_rows + 1).toArrow().column("__s").to_pylist()
    if len(distinct) > broadcast_rows:
        return each(df, item).join(own, "__s").groupBy(mark, item).agg(F.count(F.lit(1)).alias("n_shared"))
    rows = df.select(item, F.col(text).alias("__text"))
    kind = rows.schema[item]
    if not distinct:
        return own.join(rows.limit(0)).groupBy(mark, item).agg(F.count(F.lit(1)).alias("n_shared"))
    table = Passages(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [table.found(t.as_py()) for t in b.column(1)]
            at = np.repeat(np.arange(b.num_rows), [len(h) for h in hits])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([n for h in hits for n in h], pa.int64())], names=[item, "__n"])

    hit = rows.mapInArrow(run, T.StructType([kind, T.StructField("__n", T.LongType())]))
    numbers = spark.createDataFrame(list(enumerate(distinct)), "__n long, __s string")
    return hit.join(F.broadcast(own.join(F.broadcast(numbers), "__s").select("__n", mark)), "__n").groupBy(mark, item).agg(F.count(F.lit(1)).alias("n_shared"))


def near_patterns(bits: DataFrame, distance: int, agree: int | None = None) -> DataFrame:
    """bits, other, distance: pairs of different 64-bit patterns, bits < other, that differ in at most ``distance`` bits. bits: one column, any number of times each.

    Of ``distance + agree`` blocks of bits two such patterns agree in at least ``agree``, so an equi-join on all choices of so many blocks finds them all: for 6 and 3, 84 keys of some 21 bits
    a pattern. Larger ``agree``: more and smaller buckets. Unset, it is the smallest at which a key has four times as many values as there are patterns, by their counted number, and 8 at most.
    """
    name = bits.columns[0]
    distinct = bits.where(F.col(name).isNotNull()).select(F.col(name).alias("bits")).distinct()
    if agree is None:
        distinct = materialize(distinct, "patterns")
        n = distinct.count()
        agree = next((k for k in range(1, 8) if 2 ** (64 * k // (distance + k)) >= 4 * n), 8)
    blocks = distance + agree
    if not (distance >= 0 and agree >= 1 and blocks <= 64):
        raise ValueError("the distance and the blocks that agree must add up to 64 at most")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen) for chosen in itertools.combinations(range(blocks), agree)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keyed = distinct.select("bits", F.posexplode(F.transform(F.array(*map(F.lit, signed)), lambda m: F.col("bits").bitwiseAND(m))).alias("k", "v"))
    # A merge join: a side has as many rows a pattern as there are masks, but its estimated size is nearly that of the patterns' file, by which it would be broadcast. The sides are alike and shuffled once.
    x, y = keyed.alias("x"), keyed.alias("y").hint("merge")
    met = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.v") == F.col("y.v")) & (F.col("x.bits") < F.col("y.bits"))).select("x.bits", F.col("y.bits").alias("other"))
    return met.withColumn("distance", F.bit_count(F.col("bits").bitwiseXOR(F.col("other")))).where(F.col("distance") <= distance).select("bits", "other", "distance").distinct()


def near_links(df: DataFrame, item: str, group: str, bits: str, distance: int = 6, agree: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links) of classes of equal patterns. members: item, representative (the class's smallest item), crosses (the class has items of several groups). links: item_a, item_b, distance of representatives whose patterns are near and
    whose classes are not both of one and the same group. However many items share a pattern, each is one row and no pairs are made of them; items without a pattern are in neither.
    """
    rows = df.where(F.col(bits).isNotNull())
    classes = materialize(rows.groupBy(F.col(bits).alias("bits")).agg(F.min(item).alias("item"), F.min(group).alias("g0"), F.max(group).alias("g1")), "classes")
    side = lambda i, key: classes.select(F.col("bits").alias(key), F.col("item").alias(f"i{i}"), F.col("g0").alias(f"g0{i}"), F.col("g1").alias(f"g1{i}"))
    j = near_patterns(classes.select("bits"), distance, agree).join(side(1, "bits"), "bits").join(side(2, "other"), "other")
    alone = (F.col("g01") == F.col("g11")) & (F.col("g02") == F.col("g12")) & (F.col("g01") == F.col("g02"))
    links = j.where(~F.coalesce(alone, F.lit(False))).select(F.least("i1", "i2").alias("item_a"), F.greatest("i1", "i2").alias("item_b"), "distance")
    members = rows.select(F.col(item).alias(item), F.col(bits).alias("bits")).join(classes.withColumnRenamed("item", "representative"), "bits")
    return members.select(item, "representative", F.coalesce(F.col("g0") < F.col("g1"), F.lit(False)).alias("crosses")), links


def near_pairs(df: DataFrame, item: str, group: str, bits: str, distance: int = 6, exceptions: DataFrame | None = None, agree: int | None = None) -> DataFrame:
    """Pairs of items of different groups whose patterns differ in at most ``distance`` bits, but for the excepted ones (a, b). Pairs of items are many where patterns repeat: for short lists that people look at; near_links is for the rest."""
    patterns = df.where(F.col(bits).isNotNull()).select(F.col(item).alias("item"), F.col(group).alias("grp"), F.col(bits).alias("bits"))
    met = near_patterns(patterns.select("bits"), distance, agree)
    same = patterns.select("bits", F.col("bits").alias("other"), F.lit(0).alias("distance")).distinct()
    left = patterns.select("bits", F.col("item").alias("i1"), F.col("grp").alias("g1"))
    right = patterns.select(F.col("bits").alias("other"), F.col("item").alias("i2"), F.col("grp").alias("g2"))
    pairs = met.unionByName(same).join(left, "bits").join(right, "other").where("g1 <> g2 AND (bits <> other OR i1 < i2)")
    pairs = pairs.select(F.least("i1", "i2").alias("item_a"), F.greatest("i1", "i2").alias("item_b"), "distance")
    if exceptions is not None:
        allowed = exceptions.select(F.least("a", "b").alias("item_a"), F.greatest("a", "b").alias("item_b"))
        pairs = pairs.join(allowed, ["item_a", "item_b"], "left_anti")
    return pairs


def stars(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node that is not the smallest of its component; root is that smallest node. Alternating large-star and small-star steps.

    Loops, repeated edges and null ends do no harm. A step keeps at most as many rows as there are edges. Minima are aggregated before their shuffle and
    written, so that the join after them may split a hot node; a count and a checksum, all that comes to the driver, decide when to stop.
    """
    high, low = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    e = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(high.alias("u"), low.alias("v")).where("u <> v").distinct(), "edges")
    lowest = lambda x: materialize(x.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest", 2 * state[0])
    checksum = lambda x: tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    state = checksum(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = materialize(both.join(lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", state[0])
        met = e.join(lowest(e), "u")
        e = materialize(met.select("u", F.col("m").alias("v")).unionByName(met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "small", 2 * state[0])
        before, state = state, checksum(e)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its smallest node) for all nodes of the edges."""
    ends = materialize(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL"), "ends")
    nodes = ends.select("x").unionByName(ends.select(F.col("y").alias("x"))).distinct()
    return nodes.join(stars(ends, "x", "y"), F.col("x") == F.col("node"), "left").select(F.col("x").alias("node"), F.coalesce("root", "x").alias("component"))
