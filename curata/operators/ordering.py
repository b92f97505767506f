"""Positions and running sums over an order of any length: a range sort, a sum a task, and one carried row a range.

No window over a hot group or over a whole table: rows are dealt by ranges of the whole sort key, so a group of any share spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.plans.storage import FILE_ROWS, materialize, ship


def running_sums(df: DataFrame, keys: Sequence[str], sums: Mapping[str, str | None], by: int = 0, row_id: str | None = None, rows: int | None = None) -> DataFrame:
    """df and, for each name -> column of ``sums``, the column's sum over the rows up to and with this one in the order of ``keys`` (None: their number).

    Sums start anew where one of the first ``by`` keys changes. The columns are non-negative whole numbers without nulls. Keys sort as Spark sorts them, nulls first;
    rows of equal keys come in any order and into one task, so the keys should tell rows apart. ``row_id`` names a column of distinct numbers, if wanted.
    rows, an upper bound of what df holds, keeps small tables of narrow rows from being dealt into a range for each shuffle partition.
    """
    spark = df.sparkSession
    ship(spark)
    if clash := {"__group", "__head", "__part", "__row", *(f"__sum{i}" for i in range(len(sums)))} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns of names that are used here: {', '.join(sorted(clash))}")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None:
        n = min(n, max(1, -(-rows // FILE_ROWS)))
    group = F.xxhash64(*[c for k in keys[:by] for c in (F.col(k).isNull(), F.col(k))]) if by else F.lit(0).cast("long")
    ranged = df.withColumn("__group", group).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    names, at = list(sums), [df.columns.index(c) if c else None for c in sums.values()]
    mark = len(df.columns)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, first, last = TaskContext.get().partitionId(), 0, True, None
        total, base = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            marks = b.column(mark).to_numpy(zero_copy_only=False)
            new = np.empty(m, dtype=bool)
            new[0], new[1:] = last is not None and marks[0] != last, marks[1:] != marks[:-1]
            of, out = np.cumsum(new), []
            for i, column in enumerate(at):
                v = np.ones(m, dtype=np.int64) if column is None else b.column(column).to_numpy(zero_copy_only=False).astype(np.int64)
                c = np.cumsum(v) + total[i]
                bases = np.concatenate([[base[i]], (c - v)[new]])
                out.append(pa.array(c - bases[of], pa.int64()))
                total[i], base[i] = c[-1], bases[-1]
            head = (of == 0) & first
            first, last = bool(head[-1]), marks[-1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *out, pa.array(head), pa.array(np.full(m, part), pa.int32()), pa.array((part << 40) + seen + np.arange(m), pa.int64())], names=[*b.schema.names, *local_names, "__head", "__part", "__row"]
            )
            seen += m

    local_names = [f"__sum{i}" for i in range(len(names))]
    fields = [*ranged.schema.fields, *(T.StructField(x, T.LongType()) for x in local_names), T.StructField("__head", T.BooleanType()), T.StructField("__part", T.IntegerType()), T.StructField("__row", T.LongType())]
    local = materialize(ranged.mapInArrow(add_up, T.StructType(fields)), "ranges")
    # one row for each range, as many as there are shuffle partitions
    ends = local.groupBy("__part").agg(
        F.min_by("__group", "__row").alias("begins"), F.max_by("__group", "__row").alias("ends"), F.bool_and("__head").alias("single"), *[F.max_by(x, "__row").alias(x) for x in local_names]
    )
    order = Window.orderBy("__part")
    ends = ends.withColumn("goes_on", F.coalesce(F.lag("ends").over(order) == F.col("begins"), F.lit(False)))
    ends = ends.withColumn("chain", F.count_if(~(F.col("single") & F.col("goes_on"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    for x in local_names:
        ends = ends.withColumn(f"{x}_end", F.sum(x).over(Window.partitionBy("chain").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)))
    carried = ends.select("__part", *[F.when(F.col("goes_on"), F.lag(f"{x}_end").over(order)).otherwise(0).alias(f"{x}_carried") for x in local_names])
    add = [(F.col(x) + F.when(F.col("__head"), F.col(f"{x}_carried")).otherwise(0)).alias(name) for x, name in zip(local_names, names, strict=True)]
    return local.join(F.broadcast(carried), "__part").select(*[f"`{c}`" for c in df.columns], *add, *([F.col("__row").alias(row_id)] if row_id else []))


def first_n(df: DataFrame, n: int, order: Sequence[Column | str], by: Sequence[str] = (), place: str = "place") -> DataFrame:
    """The first n rows of each group, or of the whole table, and their place from 1. Ties of the order are settled by the other columns, as Spark sorts them, so the result is one and the same on every layout.

    Only n rows of a group leave a task: a ranked window with a limit is limited within tasks before the shuffle, up to n of a thousand, which is the most that is allowed.
    """
    if not 0 < n <= 1000:
        raise ValueError("n is from 1 to 1,000")
    sortable = [f"`{f.name}`" for f in df.schema if f.name not in by and not isinstance(f.dataType, T.MapType | T.VariantType)]
    whole = [F.col(c) if isinstance(c, str) else c for c in order] + [F.col(c) for c in sortable]
    if not by:
        df, place_of = df.orderBy(*whole).limit(n), Window.orderBy(*whole)  # n rows in all
    else:
        place_of = Window.partitionBy(*[F.col(f"`{c}`") for c in by]).orderBy(*whole)
    ranked = df.withColumn(place, F.row_number().over(place_of))
    return ranked.where(F.col(place) <= n)


def latest_before(left: DataFrame, right: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """left with the ``columns`` of that row of right which has its key and the greatest ``at`` not above its own; null where there is none.

    Of several such rows of right the greatest by ``columns`` counts. One sort of both sides by ranges of (key, at); each task remembers one row of right, and each range passes one on to the next, so a key of any share spreads over
    many tasks. Rows whose key or ``at`` is null meet nothing.
    """
    spark = left.sparkSession
    ship(spark)
    whole, own = F.struct(*[F.col(f"`{c}`") for c in left.columns]), F.struct(*[F.col(f"`{c}`") for c in columns])
    kind_l, kind_r = left.select(whole.alias("x")).schema["x"].dataType, right.select(own.alias("x")).schema["x"].dataType
    void_l, void_r = (F.lit(None).cast(k) for k in (kind_l, kind_r))
    side = lambda df, n, row, got: df.select(F.col(key).alias("key"), F.col(at).alias("at"), F.lit(n).alias("side"), row.alias("row"), got.alias("got"))
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    both = side(left, 1, whole, void_r).unionByName(side(right.where(known), 0, void_l, own))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = F.col("key").isNotNull() & F.col("at").isNotNull()
    ranged = both.withColumn("mark", F.when(met, F.xxhash64("key"))).repartitionByRange(n, "key", "at", "side", "got").sortWithinPartitions("key", "at", "side", "got").select("mark", "side", "row", "got")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mark, held, head, seen = TaskContext.get().partitionId(), None, None, True, False
        names = ["row", "got", "mark", "open", "part", "last"]
        for b in batches:
            m, got = b.num_rows, b.column(3)
            if not m:
                continue
            marks = b.column(0).to_pylist()
            sides = b.column(1).to_numpy(zero_copy_only=False)
            from_held = pa.nulls(1, got.type) if held is None else held
            take, opened, last, fresh = [], [], -1, False  # last: the newest row of right in this batch and run
            for i, (k, s) in enumerate(zip(marks, sides, strict=True)):
                if seen and k != mark:
                    head, last, fresh = False, -1, True
                mark, seen = k, True
                if s == 0:
                    last, fresh = i, True
                take.append(last + 1 if last >= 0 else 0 if not fresh else None)
                opened.append(head and last < 0 and held is None and k is not None)
            pool = pa.concat_arrays([from_held, got])
            keep = pa.array(sides == 1)
            cols = [b.column(2), pool.take(pa.array(take, pa.int64())), b.column(0), pa.array(opened), pa.array(np.full(m, part), pa.int32()), pa.array(np.zeros(m, dtype=bool))]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(keep)
            held = got.slice(last, 1) if last >= 0 else None if fresh else held
        if seen:
            through = head and held is None  # one run, nothing of right in it: what came in goes on
            kind = b.column(2).type
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind), pa.nulls(1, got.type) if held is None else held, pa.array([mark], pa.int64()), pa.array([through]), pa.array([part], pa.int32()), pa.array([True])], names=names
            )

    schema = T.StructType([T.StructField("row", kind_l), T.StructField("got", kind_r), T.StructField("mark", T.LongType()), T.StructField("open", T.BooleanType()), T.StructField("part", T.IntegerType()), T.StructField("last", T.BooleanType())])
    local = materialize(ranged.mapInArrow(carry, schema), "latest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range, as many as there are shuffle partitions
    ends = local.where("last").select("part", F.when(~F.col("open"), F.struct("mark", "got")).alias("given"))
    came = ends.select(F.col("part").alias("of"), F.last("given", ignorenulls=True).over(before).alias("came"))
    j = local.where("NOT last").join(F.broadcast(came), F.col("part") == F.col("of"), "left")
    got = F.when(F.col("open") & (F.col("mark") == F.col("came.mark")), F.col("came.got")).otherwise(F.col("got"))
    return j.select("row", got.alias("got")).select("row.*", *[F.col(f"got.`{c}`").alias(c) for c in columns])
