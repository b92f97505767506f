"""Group-aware stratified splits: eligibility of whole groups, hash shuffle, round-robin interleave, proportional deal, and what verifies them.

Shuffles order by a digest of seed, label, stratum and id: as deterministic as a seeded generator, but not its order. Positions within a class come
from range sorts over groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.operators.ordering import running_sums
from curata.plans.storage import broadcast_if_small, materialize

HOLDOUT = (("train", 0.7), ("val", 0.15), ("test", 0.15))


def eligibility(label: Column, split: Column, reason: Column, trainable: Sequence[str], held_out: Sequence[str]) -> Column:
    """struct(ok, reason), in this order: excluded, held out, not in the specification, eligible."""
    verdict = lambda ok, why: F.struct(F.lit(ok).alias("ok"), why.alias("reason"))
    return (
        F.when(F.coalesce(split, F.lit("unassigned")) == "excluded", verdict(False, F.concat(F.lit("split=excluded ("), F.coalesce(reason, F.lit("no reason")), F.lit(")"))))
        .when(F.coalesce(label.isin(*held_out), F.lit(False)), verdict(False, F.concat(F.lit("held_out_label:"), label)))
        .when(F.coalesce(label.isin(*trainable), F.lit(False)), verdict(True, F.lit("eligible")))
        .otherwise(verdict(False, F.concat(F.lit("label "), F.coalesce(label, F.lit("None")), F.lit(" not in class specification"))))
    )


def eligible_groups(df: DataFrame, group: str, item: str, label: str, verdict: str) -> DataFrame:
    """One row for each group: status (eligible, excluded, mixed_verdict, mixed_label), label, n_items, first_item, excluded reason (the smallest)."""
    g = df.groupBy(group).agg(
        F.bool_and(F.col(f"{verdict}.ok")).alias("all_ok"), F.bool_or(F.col(f"{verdict}.ok")).alias("any_ok"), F.min(label).alias("l0"), F.max(label).alias("l1"),
        F.count(F.lit(1)).alias("n_items"), F.min(item).alias("first_item"), F.min(f"{verdict}.reason").alias("why"),
    )
    status = F.when(~F.col("any_ok"), "excluded").when(~F.col("all_ok"), "mixed_verdict").when(F.col("l0") != F.col("l1"), "mixed_label").otherwise("eligible")
    out = g.withColumn("status", status)
    return out.select(group, "status", F.when(F.col("status") == "eligible", F.col("l0")).alias("label"), "n_items", "first_item", F.when(F.col("status") == "excluded", F.col("why")).alias("excluded_reason"))


def splittable(groups: DataFrame, label: str, classes: Sequence[str], holdout_least: int, folds: int, strategy: str = "auto") -> DataFrame:
    """One row: strategy and problems, empty where a split may be made."""
    n = [F.count_if(F.col(label) == c).alias(f"n{i}") for i, c in enumerate(classes)]
    row = groups.agg(*n)
    counts = F.array(*[f"n{i}" for i in range(len(classes))])
    holdout, kfold = F.forall(counts, lambda x: x >= holdout_least), F.forall(counts, lambda x: x >= folds)
    chosen = F.when(holdout, "holdout").otherwise("grouped_kfold") if strategy == "auto" else F.lit(strategy)
    row = row.withColumn("strategy", chosen)
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(f"n{i}") == 0, F.lit(c)) for i, c in enumerate(classes)]), lambda x: x.isNotNull()), ",")
    problems = F.filter(
        F.array(
            F.when(missing != "", F.concat(F.lit("no groups of "), missing)),
            F.when((F.col("strategy") == "holdout") & ~holdout, F.lit(f"holdout needs {holdout_least} groups a class")),
            F.when((F.col("strategy") == "grouped_kfold") & ~kfold, F.lit(f"k-fold needs {folds} groups a class")),
        ),
        lambda x: x.isNotNull(),
    )
    return row.select("strategy", F.array_join(problems, "; ").alias("problems"))


def deal_plan(ratios: Sequence[float], n: int) -> list[int]:
    """Which partition the items at positions 0 to n - 1 go to: the one furthest below its share, ties to the earlier.

    With at least as many items as partitions, the first items go one to each partition, largest ratio first.
    """
    counts, out = [0] * len(ratios), []
    if n >= len(ratios):
        out = sorted(range(len(ratios)), key=lambda i: -ratios[i])
        counts = [1] * len(ratios)
    while len(out) < n:
        total = sum(counts) + 1
        best = max(range(len(ratios)), key=lambda i: (ratios[i] * total - counts[i], -i))
        counts[best] += 1
        out.append(best)
    return out


#: Strata up to which a position is worked out from their sizes; with more, from a second sort.
FEW_STRATA = 1000


def interleave(groups: DataFrame, group: str, label: str, stratum: str, seed: int, few: int = FEW_STRATA) -> DataFrame:
    """groups with ``position`` (from 0) in their class: strata shuffled by digest, then drawn in turn, largest stratum first. A group's turn comes from a range sort, so a class may hold all groups.

    In turn t each stratum of t groups or more gives one, and those before a stratum that gives have given too; so the position is the sum of min(size, t - 1) over the class's strata and the stratum's rank.
    """
    key = F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), F.col(label), F.col(stratum).cast("string"), F.col(group).cast("string")), 256)
    keyed = groups.withColumn("__h", key)
    sizes = keyed.groupBy(F.col(label).alias("__l"), F.col(stratum).alias("__s")).agg(F.count(F.lit(1)).alias("__size"), F.min(F.struct("__h", group))[group].alias("__first"))
    sizes = materialize(sizes, "strata")
    turned = running_sums(keyed, [label, stratum, "__h", group], {"__turn": None}, by=2)
    same = F.col(label).eqNullSafe(F.col("__l")) & F.col(stratum).eqNullSafe(F.col("__s"))
    if sizes.limit(few + 1).count() > few:
        w = turned.join(sizes.withColumn("__size", -F.col("__size")), same).drop("__l", "__s")
        placed = running_sums(w, [label, "__turn", "__size", "__first", "__h"], {"__i": None}, by=1)
        return placed.withColumn("position", F.col("__i") - 1).drop("__h", "__turn", "__size", "__first", "__i")
    # one row a stratum, and one array of sizes a class
    rank = F.row_number().over(Window.partitionBy("__l").orderBy(F.desc("__size"), "__first"))
    of_class = sizes.groupBy(F.col("__l").alias("__c")).agg(F.collect_list("__size").alias("__sizes"))
    ranked = sizes.withColumn("__rank", rank).join(of_class, F.col("__l").eqNullSafe(F.col("__c"))).select("__l", "__s", "__rank", "__sizes")
    w = turned.join(F.broadcast(ranked), same)
    earlier = F.aggregate("__sizes", F.lit(0).cast("long"), lambda total, n: total + F.least(n, F.col("__turn") - 1))
    return w.withColumn("position", earlier + F.col("__rank") - 1).drop("__h", "__turn", "__l", "__s", "__rank", "__sizes")


def assign(groups: DataFrame, group: str, label: str, stratum: str, names: Sequence[str], ratios: Sequence[float], seed: int = 7) -> DataFrame:
    """group, label, position, partition. The deal repeats itself where the ratios are hundredths: position i beyond two hundred goes where i - 100 k went."""
    counts = groups.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).select(F.col(label).alias("__l"), "__n")
    placed = interleave(groups, group, label, stratum, seed)
    placed = placed.join(broadcast_if_small(counts), F.col(label).eqNullSafe(F.col("__l"))).drop("__l")
    k = len(names)
    period, lead = 100, 200
    long, short = deal_plan(ratios, lead), {n: deal_plan(ratios, n) for n in range(1, k)}
    if deal_plan(ratios, lead + 3 * period)[lead:] != long[lead - period :] * 3:
        raise ValueError("the ratios must be whole hundredths")
    index = F.when(F.col("position") < lead, F.col("position")).otherwise(lead - period + (F.col("position") - lead) % period)
    chosen = F.element_at(F.array(*map(F.lit, long)), (index + 1).cast("int"))
    for n, plan in short.items():
        chosen = F.when(F.col("__n") == n, F.try_element_at(F.array(*map(F.lit, plan)), (F.col("position") + 1).cast("int"))).otherwise(chosen)
    return placed.withColumn("partition", F.element_at(F.array(*map(F.lit, names)), chosen + 1)).drop("__n")


def fold_view(assignments: DataFrame, fold: int, partition: str = "partition") -> DataFrame:
    """k-fold assignments seen from one fold: that fold is val, the others train."""
    return assignments.withColumn(partition, F.when(F.col(partition) == f"fold_{fold}", "val").otherwise("train"))


def adopt(df: DataFrame, group: str, split: str) -> DataFrame:
    """The splits that groups carry already: one row a group, with its split, or null and how many it has."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("n_splits"), F.min(split).alias("s")).select(group, F.when(F.col("n_splits") == 1, F.col("s")).alias("split"), "n_splits")


def summary(df: DataFrame, partition: str, group: str, label: str, stratum: str) -> DataFrame:
    """Groups and items by partition, by partition and class, and by partition and stratum: one pass of grouping sets over groups."""
    g = df.groupBy(partition, group, label, stratum).agg(F.count(F.lit(1)).alias("n"))
    sets = g.groupingSets([[partition], [partition, label], [partition, stratum]], partition, label, stratum)
    return sets.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_items"))


def overlaps(df: DataFrame, partition: str, keys: Sequence[str]) -> DataFrame:
    """Keys that stand in several partitions, for each kind of key: kind, n_keys. Empty kinds count 0."""
    out = None
    for k in keys:
        one = df.where(F.col(k).isNotNull()).groupBy(k).agg(F.count_distinct(partition).alias("n")).agg(F.lit(k).alias("kind"), F.count_if(F.col("n") > 1).alias("n_keys"))
        out = one if out is None else out.unionByName(one)
    return out


def accounting(df: DataFrame, group: str, assigned: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row: groups both assigned and excluded, groups of the data that are neither, and groups named but not in the data."""
    marks = df.select(group).distinct().withColumn("d", F.lit(1)).join(assigned.select(group).distinct().withColumn("a", F.lit(1)), group, "full_outer").join(excluded.select(group).distinct().withColumn("e", F.lit(1)), group, "full_outer")
    has = lambda c: F.col(c).isNotNull()
    return marks.agg(F.count_if(has("a") & has("e")).alias("n_both"), F.count_if(has("d") & ~has("a") & ~has("e")).alias("n_unaccounted"), F.count_if(~has("d")).alias("n_unknown"))


def regroup(assignments: DataFrame, members: DataFrame, group: str, component: str, partition: str, label: str, order: Sequence[str] = ("train", "val", "test"), seed: int = 7) -> DataFrame:
    """group, was, partition: no component (members: group, component; of several groups) is left divided, and no class count of a partition changes.

    A component goes to the partition that holds most of its groups, the earlier in ``order`` among equals. Then, class by class, groups of no component move from partitions that
    have gained to those that have lost, by name, in the order of a digest of the seed. Raises ValueError if there are too few of them.
    """
    if not assignments.where(~F.coalesce(F.col(partition).isin(*order), F.lit(False))).isEmpty():
        raise ValueError(f"partitions other than {', '.join(order)}")
    rows = assignments.select(F.col(group).alias("g"), F.col(partition).alias("was"), F.col(label).alias("l")).join(members.select(F.col(group).alias("g"), F.col(component).alias("c")), "g", "left")
    shared = rows.where("c IS NOT NULL").groupBy("c", "was").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.array_position(F.array(*map(F.lit, order)), F.col("was")))
    home = shared.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), "rank", "was"))["was"].alias("home"), F.sum("n").alias("size"))
    moved = materialize(rows.join(home, "c", "left").select("g", "was", "l", (F.coalesce("size", F.lit(1)) == 1).alias("alone"), F.coalesce("home", "was").alias("now")), "moved")
    both = moved.select("l", F.explode(F.array(F.struct(F.col("now").alias("p"), F.lit(1).alias("v")), F.struct(F.col("was").alias("p"), F.lit(-1).alias("v")))).alias("x"))
    change = both.groupBy("l", F.col("x.p").alias("p")).agg(F.sum("x.v").alias("d"))
    upto = Window.partitionBy("l", F.col("d") > 0).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)  # over the partitions of a class
    slots = materialize(change.where("d <> 0").withColumn("to", F.sum(F.abs("d")).over(upto)), "slots")
    gave = slots.where("d > 0").select(F.col("l").alias("gl"), F.col("p").alias("gp"), "d", (F.col("to") - F.col("d")).alias("before"))
    took = slots.where("d < 0").select(F.col("l").alias("tl"), F.col("p").alias("dest"), F.col("to").alias("last"), (F.col("to") + F.col("d")).alias("first"))
    free = moved.where("alone").join(broadcast_if_small(gave), F.col("l").eqNullSafe(F.col("gl")) & (F.col("now") == F.col("gp"))).withColumn("h", F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), F.lit("rebalance"), F.col("g").cast("string")), 256))
    ranked = running_sums(free, ["l", "now", "h", "g"], {"k": None}, by=2).where("k <= d").withColumn("slot", F.col("before") + F.col("k"))
    swaps = materialize(ranked.join(broadcast_if_small(took), F.col("l").eqNullSafe(F.col("tl")) & (F.col("slot") > F.col("first")) & (F.col("slot") <= F.col("last"))).select("g", "dest"), "swaps")
    wanted = gave.agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0]
    if (found := swaps.count()) < wanted:
        raise ValueError(f"class counts cannot be restored: {wanted} groups of no component are needed, {found} are there")
    return moved.join(swaps, "g", "left").select(F.col("g").alias(group), "was", F.coalesce("dest", "now").alias("partition"))
