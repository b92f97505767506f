"""Class counts, weights and samples over groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.operators.ordering import running_sums
from curata.plans.storage import materialize


def value_counts(df: DataFrame, columns: Sequence[str], absent: str = "unknown") -> DataFrame:
    """field, value, n: one pass over all columns; absent values count under a name."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit(absent)).alias("value")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def availability(df: DataFrame, label: str, group: str, classes: Sequence[tuple[str, str]], excluded: Column | None = None) -> DataFrame:
    """label, status, n_groups, n_items for each (label, status), zeros included, in the order given (class_no)."""
    rows = df if excluded is None else df.where(~F.coalesce(excluded, F.lit(False)))
    g = rows.groupBy(label).agg(F.count_distinct(group).alias("n_groups"), F.count(F.lit(1)).alias("n_items"))
    dim = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(classes)], f"class_no int, `{label}` string, status string")
    return dim.join(g, label, "left").select("class_no", label, "status", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce("n_items", F.lit(0)).alias("n_items"))


def class_weights(df: DataFrame, label: str, group: str) -> DataFrame:
    """label, n_groups, weight: inverse frequencies with mean 1. The window runs over classes."""
    g = df.groupBy(label).agg(F.count_distinct(group).alias("n_groups"))
    inverse = 1.0 / F.col("n_groups")
    return g.withColumn("weight", inverse / F.avg(inverse).over(Window.partitionBy()))


def sample_weights(df: DataFrame, item: str, label: str, group: str) -> DataFrame:
    """item, weight: 1 / groups of the label / items of the group. Counts are joined back, so that a hot group or label is a join that adaptive execution splits."""
    by_label = df.groupBy(label).agg(F.count_distinct(group).alias("__g"))
    by_group = df.groupBy(label, group).agg(F.count(F.lit(1)).alias("__n"))
    table = by_group.join(by_label, label).select(label, group, (1.0 / F.col("__g") / F.col("__n")).alias("weight"))
    return df.join(table, [label, group]).select(item, "weight")


def imbalance(df: DataFrame, label: str, group: str, classes: Sequence[str]) -> DataFrame:
    """label, n_groups, share (percent of the trainable groups)."""
    g = df.where(F.col(label).isin(*classes)).groupBy(label).agg(F.count_distinct(group).alias("n_groups"))
    return g.withColumn("share", 100.0 * F.col("n_groups") / F.sum("n_groups").over(Window.partitionBy()))


#: A weight of 1 counts as so many; smaller parts of it are cut off.
WEIGHT_UNIT = 1 << 40


def weighted_sample(df: DataFrame, item: str, weight: str, n: int, seed: int = 7) -> DataFrame:
    """item, times: exactly n draws with replacement, each item with a probability in proportion to its weight (in units of 2**-40; null, 0 and less are never drawn). Items are distinct.

    Draw i falls on the digest of seed and i, as a point of the line on which the items lie end to end in their order: the same draws on every layout. Items and draws
    are sorted together by ranges, so neither n nor the items need fit anywhere.
    """
    units = F.floor(F.col(weight).cast("double") * WEIGHT_UNIT).cast("long")
    rows = df.select(F.col(item).alias("item"), units.alias("w")).where("w > 0 AND item IS NOT NULL")
    line = materialize(running_sums(rows, ["item"], {"to": "w", "place": None}), "line")
    total = line.agg(F.max("to")).first()[0]
    if not total:
        return df.select(item, F.lit(0).cast("long").alias("times")).limit(0)
    point = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long") % F.lit(total)
    starts = line.select((F.col("to") - F.col("w")).alias("at"), F.lit(0).alias("draw"), "place", F.lit(1).cast("long").alias("one"))
    draws = df.sparkSession.range(n).select(point.alias("at"), F.lit(1).alias("draw"), F.col("id").alias("place"), F.lit(0).cast("long").alias("one"))
    met = running_sums(starts.unionByName(draws), ["at", "draw", "place"], {"under": "one"})
    times = met.where("draw = 1").groupBy(F.col("under").alias("place")).agg(F.count(F.lit(1)).alias("times"))
    return line.join(times, "place").select(F.col("item").alias(item), "times")


def every_kth(df: DataFrame, order: Sequence[str], k: int, by: Sequence[str]) -> DataFrame:
    """Systematic sample: of each stratum the rows 1, k + 1, 2 k + 1, ... in order, which should tell rows apart. Positions come from a range sort, so a stratum may be any share of the rows."""
    return running_sums(df, [*by, *order], {"__i": None}, by=len(by)).where((F.col("__i") - 1) % k == 0).drop("__i")


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """n_items, n_groups: how many groups have how many items."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_items")).groupBy("n_items").agg(F.count(F.lit(1)).alias("n_groups"))
