"""Promotion of agreed labels into records: who may be promoted, what changes, and a fixpoint that takes out items whose records would then break a rule.

Votes, reasons and values are aggregates by item; records are met by joins. The fixpoint writes each round below the shared folder and looks only at its counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import scalars as S
from curata.functions.absence import has_real_text
from curata.operators.evidence import CONFIDENCE
from curata.plans.storage import materialize

DISPUTED, ABSENT = "disputed", "not_available"


def eligible(status: DataFrame, experts: DataFrame, item: str, flags: DataFrame, no_label: Sequence[str] = ("other_script",)) -> DataFrame:
    """item, label, reasons: every item with a status and why it may not be promoted (an empty array: it may).

    status: item, status, label, ground_truth. experts: item, qualification, present, object_status, the reviewed expert rows (of an adjudicated item the adjudication alone). flags: item of possible reproductions.
    """
    g = experts.groupBy(item).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~has_real_text(F.col("qualification"))).alias("unqualified"), F.count_distinct(F.coalesce("present", F.lit("unknown"))).alias("presences"),
        F.bool_or(F.col("object_status") == "reproduction").alias("copy"), F.bool_or(F.col("object_status") == "uncertain").alias("unsure"), F.bool_and(F.coalesce(F.col("object_status") == "original", F.lit(False))).alias("original"),
    )
    j = status.select(item, "status", "label", "ground_truth").join(g, item, "left").join(flags.select(item).distinct().withColumn("flagged", F.lit(True)), item, "left")
    open_status = ~F.coalesce(F.col("status").isin("expert_label", "adjudicated") & F.col("ground_truth") & F.col("label").isNotNull(), F.lit(False))
    later = S.present(
        (F.col("n").isNull(), "P2 no reviewed expert row"), (F.col("unqualified") > 0, "P2 no qualification"), (F.col("presences") > 1, "P3 presence disputed"), (F.col("label").isin(*no_label), "P4 label needs detail"),
        (F.col("copy"), "P10 reproduction"), (~F.col("copy") & F.col("unsure"), "P10 status uncertain"), (F.col("flagged") & ~F.coalesce("original", F.lit(False)), "P10 flagged, not stated original"),
    )
    return j.select(item, "label", F.when(open_status, F.array(F.concat(F.lit("P1 status "), F.coalesce("status", F.lit("none"))))).otherwise(later).alias("reasons"))


def agreed(experts: DataFrame, item: str, unanimous: Sequence[str], ranges: Sequence[tuple[str, str]] = (), confidence: str | None = None) -> DataFrame:
    """item, and for each field the value that all of an item's rows share: null if none states it or only some do, 'disputed' if stated values differ.

    Text is compared with its white space collapsed; sentinels are no values. A range (two columns) stays only if every row has the same one. Of ``confidence`` the lowest is kept.
    """
    value = lambda f: F.when(has_real_text(F.col(f).cast("string")), S.collapse_space(F.col(f).cast("string")))
    made = [F.when(F.count_distinct(value(f)) > 1, DISPUTED).when(F.count(value(f)) == F.count(F.lit(1)), F.min(value(f))).alias(f) for f in unanimous]
    for lo, hi in ranges:
        same = F.count_distinct(F.coalesce(F.col(lo).cast("string"), F.lit("")), F.coalesce(F.col(hi).cast("string"), F.lit(""))) == 1
        made += [F.when(same, F.min(lo)).alias(lo), F.when(same, F.min(hi)).alias(hi)]
    if confidence:
        rank = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.coalesce(confidence, F.lit("unknown")))
        made.append(F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.greatest(F.min(rank), F.lit(1)).cast("int")).alias(confidence))
    return experts.groupBy(item).agg(*made)


def region_pixels(regions: DataFrame, records: DataFrame, image: str) -> DataFrame:
    """Regions in shares of an image's sides as pixels, with ``problem``: of no record, or of one without whole-numbered sides. regions: image, region (x, y, w, h); records: image, width, height."""
    j = regions.join(records.select(image, "width", "height").withColumn("__there", F.lit(True)), image, "left")
    what = F.when(F.col("__there").isNull(), "P5 no record").when(F.col("width").isNull() | F.col("height").isNull() | (F.least("width", "height") < 1), "P5 no size")
    return j.withColumn("pixels", F.when(what.isNull(), S.to_pixels(F.col("region"), F.col("width"), F.col("height")))).withColumn("problem", what).drop("__there", "width", "height")


def plan_changes(records: DataFrame, ready: DataFrame, values: DataFrame, item: str, record: str, fields: Sequence[str], writable: Sequence[str], label: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(changes, refusals). changes: record, item, field, before, after, for each field in which a record differs from its item's agreed values (null: leave alone).

    refusals: item, reason: an item without records (P5), with a record that does not say unknown and is not labelled by experts (P6), or that would change a field that may not be written (P8). Refused items have no changes.
    ready: item, label. values: item and ``fields``, all as text; the label and its source are set besides them.
    """
    j = ready.select(item, F.col("label").alias("__label")).join(values.select(item, *[F.col(f).alias(f"__{f}") for f in fields]), item, "left")
    bare = j.join(records.select(item).distinct(), item, "left_anti").select(item, F.lit("P5 no records").alias("reason"))
    rows = records.select(record, item, label, source, *fields).join(j, item)
    taken = ~F.col(label).eqNullSafe(F.lit("unknown")) & ~F.col(source).eqNullSafe(F.lit("expert_annotation"))
    news = {label: F.col("__label"), source: F.lit("expert_annotation")} | {f: F.col(f"__{f}").cast("string") for f in fields}
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("before"), a.cast("string").alias("after")) for f, a in news.items()])
    rows = rows.select(record, item, taken.alias("__taken"), F.filter(each, lambda x: x["after"].isNotNull() & ~x["before"].eqNullSafe(x["after"])).alias("__changes"))
    illegal = F.exists("__changes", lambda x: ~x["field"].isin(*writable))
    refused = rows.select(item, F.when(F.col("__taken"), "P6 labelled by another source").when(illegal, "P8 protected field").alias("reason")).where("reason IS NOT NULL").distinct().unionByName(bare)
    changes = rows.join(refused.select(item).distinct(), item, "left_anti").select(record, item, F.explode("__changes").alias("x")).select(record, item, "x.*")
    return changes, refused


def apply_changes(records: DataFrame, changes: DataFrame, record: str, fields: Sequence[str]) -> DataFrame:
    """records with the changes' after values."""
    wide = changes.groupBy(record).agg(*[F.max(F.when(F.col("field") == f, F.struct(F.lit(True).alias("on"), F.col("after").alias("v")))).alias(f"__{f}") for f in fields])
    j = records.join(wide, record, "left")
    for f in fields:
        j = j.withColumn(f, F.when(F.col(f"__{f}.on"), F.col(f"__{f}.v").cast(records.schema[f].dataType)).otherwise(F.col(f)))
    return j.select(*records.columns)


def settle(records: DataFrame, changes: DataFrame, find: Callable[[DataFrame], DataFrame], item: str, record: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(changes that stand, rejected): items one of whose changed records has a finding once all changes are made are taken out, until none is.

    find(records) gives a column ``record`` (its name) and ``rule`` for each error. rejected: item, rule. Each round takes out an item at least, so it ends; as a rule after one or two rounds.
    """
    rejected, left = None, materialize(changes, "promotion")
    while True:
        after = apply_changes(records, left, record, fields)
        found = find(after).select(record, "rule").join(left.select(record, item).distinct(), record).select(item, "rule").distinct()
        bad = materialize(found, "promotion-bad")
        if bad.isEmpty():
            return left, rejected if rejected is not None else bad
        rejected = bad if rejected is None else rejected.unionByName(bad)
        left = materialize(left.join(bad.select(item).distinct(), item, "left_anti"), "promotion")
