"""Reports over records: audits, statistics, label coverage, progress of an annotation round, manifests, acquisition batches. Each is a long table of counts, so no value list is gathered into a row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import scalars as S
from curata.functions.absence import has_real_text
from curata.operators.ordering import running_sums
from curata.plans.storage import broadcast_if_small

ABSENT, UNKNOWN = "<absent>", "unknown"
Mark = tuple[Column, str, Column | None]


def tally(df: DataFrame, marks: Sequence[Mark]) -> DataFrame:
    """metric, key, n: for each (condition, metric, key or None) the rows that meet the condition, in one pass. A null condition is not met; a null key is the empty one."""
    one = [F.when(when, F.struct(F.lit(metric).alias("metric"), F.coalesce(F.lit("") if key is None else key.cast("string"), F.lit("")).alias("key"))) for when, metric, key in marks]
    return df.select(F.explode(F.filter(F.array(*one), lambda x: x.isNotNull())).alias("x")).groupBy(F.col("x.metric").alias("metric"), F.col("x.key").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def has_bound(low: str, high: str) -> Column:
    return F.col(low).isNotNull() | F.col(high).isNotNull()


def _single(df: DataFrame, metric: str, n: Column) -> DataFrame:
    return df.agg(F.coalesce(n, F.lit(0)).cast("bigint").alias("n")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), "n")


def group_labels(df: DataFrame, group: str, label: str) -> DataFrame:
    """label, n: groups that hold the label, each once; a group of several labels counts under each, one without any under the absent one. Rows of no group do not count."""
    pairs = df.where(F.col(group).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("m"))
    bare = pairs.groupBy(group).agg(F.max(label).alias("top")).where("top IS NULL").agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(ABSENT).alias("label"), "n")
    return pairs.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).unionByName(bare)


def audit(df: DataFrame, group: str, label: str, digest: str, present: Sequence[str], tallies: Sequence[str], bounds: tuple[str, str]) -> DataFrame:
    """metric, key, n: records, records without a digest, with a bound, with a real value in a field, values of a field (absent ones as <absent>), groups, digests, largest group, groups by label. A null and an absent cell are the same in a typed column."""
    every, value = F.lit(True), lambda f: F.coalesce(F.col(f).cast("string"), F.lit(ABSENT))
    marks: list[Mark] = [(every, "records", None), (~has_real_text(F.col(digest)), "without_digest", None), (has_bound(*bounds), "with_bound", None)]
    marks += [(has_real_text(F.col(f)), f"present:{f}", None) for f in present] + [(every, f"value:{f}", value(f)) for f in tallies]
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("m"))
    out = tally(df, marks).unionByName(_single(sizes, "groups", F.count(F.lit(1)))).unionByName(_single(sizes, "largest_group", F.max("m")))
    out = out.unionByName(_single(df.where(has_real_text(F.col(digest))), "digests", F.count_distinct(digest)))
    return out.unionByName(group_labels(df, group, label).select(F.lit("groups_by_label").alias("metric"), F.col("label").alias("key"), "n"))


def statistics(df: DataFrame, group: str, fields: Sequence[str], bounds: tuple[str, str], findings: DataFrame, partitions: DataFrame) -> DataFrame:
    """metric, key, n: rows, groups, rows with a bound, values of each field (absent as unknown), findings by rule, and groups and rows of each partition (partitions: group, partition)."""
    marks: list[Mark] = [(F.lit(True), "images", None), (has_bound(*bounds), "with_bound", None), *[(F.lit(True), f"value:{f}", F.coalesce(F.col(f).cast("string"), F.lit(UNKNOWN))) for f in fields]]
    out = tally(df, marks).unionByName(_single(df, "groups", F.count_distinct(group)))
    out = out.unionByName(findings.groupBy(F.col("rule").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("findings").alias("metric"), "key", "n"))
    sized = df.groupBy(group).agg(F.count(F.lit(1)).alias("m")).join(partitions.select(group, "partition"), group)
    parts = sized.groupBy("partition").agg(F.count(F.lit(1)).alias("groups"), F.sum("m").alias("images"))
    each = F.explode(F.array(*[F.struct(F.lit(f"partition_{k}").alias("metric"), F.col("partition").alias("key"), F.col(k).cast("bigint").alias("n")) for k in ("groups", "images")]))
    return out.unionByName(parts.select(each.alias("x")).select("x.*"))


def ordered_counts(df: DataFrame, field: str) -> DataFrame:
    """field, n in the order of a report: the largest count first, equal counts by value."""
    return df.groupBy(field).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(field))


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in the order of their first row: key, order of that row."""
    return df.groupBy(key).agg(F.min(order).alias(order)).orderBy(order, key)


def members(df: DataFrame, group: str, item: str) -> DataFrame:
    """group, item, position (from 1) and n, the group's size: each group's rows in order without gathering a group. Rows of no group are left out."""
    rows = df.where(F.col(group).isNotNull()).select(group, item)
    return running_sums(rows, [group, item], {"position": None}, by=1).join(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group)


def view(df: DataFrame, names: Sequence[str], aliases: Mapping[str, str] | None = None) -> DataFrame:
    """The named fields under their names; ``aliases`` says which column holds one, a field that no column holds is null."""
    at = {n: (aliases or {}).get(n, n) for n in names}
    return df.select(*[(F.col(f"`{at[n]}`") if at[n] in df.columns else F.lit(None)).alias(n) for n in names])


# -- labels and strategies ------------------------------------------------------------------------------------------------------------


def label_coverage(labels: DataFrame, label: str, classes: Sequence[tuple[str, str]]) -> DataFrame:
    """label, problem: unassigned (in the data, in no class list), unknown (listed, not in the data) or overlap (listed as trainable and as held out)."""
    listed = labels.sparkSession.createDataFrame([*classes], "label string, status string").groupBy("label").agg(F.count_distinct("status").alias("m"))
    here = labels.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct().withColumn("__here", F.lit(True))
    what = F.when(F.col("m").isNull(), "unassigned").when(F.col("m") > 1, "overlap").when(F.col("__here").isNull(), "unknown")
    return here.join(listed, "label", "full_outer").select("label", what.alias("problem")).where("problem IS NOT NULL")


# Ways to correct class imbalance; one at a time, as two would correct twice.
STRATEGIES = ("none", "class_weighted_loss", "weighted_sampling")


def one_strategy(chosen: str | Sequence[str], known: Sequence[str] = STRATEGIES) -> str:
    """The only correction asked for, or none; more than one, or one unknown, is an error."""
    asked = {chosen} if isinstance(chosen, str) else set(chosen)
    if asked - set(known):
        raise ValueError(f"unknown strategies: {sorted(asked - set(known))}")
    asked.discard("none")
    if len(asked) > 1:
        raise ValueError(f"one correction at most: {sorted(asked)}")
    return asked.pop() if asked else "none"


def confidence_distribution(df: DataFrame, truth: str, probabilities: str, classes: Sequence[str], bins: int = 10) -> DataFrame:
    """metric, key, n, value: rows right and wrong in each bin of the top probability (the last bin holds 1), rows and mean top and mean true probability by true class, share under 0.5 and mean. Truth is a class's name."""
    p = F.col(probabilities)
    at = F.array_position(F.array(*map(F.lit, classes)), F.col(truth)).cast("int")
    rows = df.select(F.col(truth).alias("t"), F.array_max(p).alias("top"), (S.argmax(p) + 1 == at).alias("right"), F.element_at(p, at).alias("own"))
    bin_no = F.least(F.floor(F.col("top") * bins), F.lit(bins - 1)).cast("int").cast("string")
    n, nothing = F.count(F.lit(1)).alias("n"), F.lit(None).cast("double")
    binned = rows.groupBy(F.when(F.col("right"), "right").otherwise("wrong").alias("metric"), bin_no.alias("key")).agg(n).withColumn("value", nothing)
    by_class = rows.groupBy(F.col("t").alias("key")).agg(n, F.avg("top").alias("mean_top"), F.avg("own").alias("mean_own"))
    each = F.explode(F.array(*[F.struct(F.lit(f"{k}_by_class").alias("metric"), F.col("key"), F.col("n"), F.col(k).alias("value")) for k in ("mean_top", "mean_own")]))
    whole = rows.agg(n, F.avg((F.col("top") < 0.5).cast("double")).alias("share_below_half"), F.avg("top").alias("mean"))
    each_whole = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.lit("").alias("key"), F.col("n"), F.col(k).alias("value")) for k in ("share_below_half", "mean")]))
    return binned.unionByName(by_class.select(each.alias("x")).select("x.*")).unionByName(whole.select(each_whole.alias("x")).select("x.*"))


# -- an annotation round --------------------------------------------------------------------------------------------------------------


def basis(log: DataFrame, item: str, kind: str, state: str, created: str, id_col: str, ranks: Mapping[str, int]) -> DataFrame:
    """item and the id of its basis row: of the human rows a reviewed one, then the best rank of its kind, then the oldest, then the smallest id."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col(kind)), F.lit(len(ranks)))
    first = F.struct((~F.col(state).eqNullSafe(F.lit("expert_reviewed"))).alias("a"), rank.alias("b"), F.col(created).alias("c"), F.col(id_col).alias("d"))
    return log.where(~F.col(kind).eqNullSafe(F.lit("ai_prediction"))).groupBy(item).agg(F.min_by(id_col, first).alias("basis"))


def with_sidecars(records: DataFrame, quality: DataFrame, usability: DataFrame, digest: str, image: str, order: str) -> DataFrame:
    """records with ``quality``, the last sidecar of their digest, and ``usability``, the last judgement of their image; null where there is none."""
    last = lambda df, key, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(name, order).alias(name))
    return records.join(last(quality, digest, "quality"), digest, "left").join(last(usability, image, "usability"), image, "left")


def round_progress(items: DataFrame, log: DataFrame, item: str, kind: str, tiers: Sequence[str], unmet: Column, known: DataFrame, status: DataFrame) -> DataFrame:
    """item, in_records, missing_tiers, n_incomplete, status, complete for each item of a round. ``unmet`` is the array of a row's open points; predictions do not count."""
    rows = log.where(F.col(kind) != "ai_prediction").withColumn("__open", F.size(unmet) > 0)
    g = rows.groupBy(item).agg(F.count_if("__open").alias("n_incomplete"), *[F.bool_or(F.col(kind) == t).alias(f"__t{i}") for i, t in enumerate(tiers)])
    lacking = F.filter(F.array(*[F.when(~F.coalesce(F.col(f"__t{i}"), F.lit(False)), F.lit(t)) for i, t in enumerate(tiers)]), lambda x: x.isNotNull())
    j = items.select(item).distinct().join(g, item, "left").join(known.select(item).distinct().withColumn("__k", F.lit(True)), item, "left").join(status.select(item, "status"), item, "left")
    j = j.select(item, F.coalesce("__k", F.lit(False)).alias("in_records"), F.array_join(lacking, ",").alias("missing_tiers"), F.coalesce("n_incomplete", F.lit(0)).alias("n_incomplete"), F.coalesce("status", F.lit("unannotated")).alias("status"))
    return j.withColumn("complete", F.col("in_records") & (F.col("missing_tiers") == "") & (F.col("n_incomplete") == 0))


def round_summary(log: DataFrame, current: DataFrame, status: DataFrame, kind: str) -> DataFrame:
    """metric, key, n: rows ever and now, current rows by kind, items by status and items that may serve as truth (status: item, status, ground_truth)."""
    out = tally(current, [(F.lit(True), "current", None), (F.lit(True), "kind", F.col(kind))]).unionByName(_single(log, "rows", F.count(F.lit(1))))
    return out.unionByName(tally(status, [(F.lit(True), "items", None), (F.lit(True), "status", F.col("status")), (F.col("ground_truth"), "ground_truth", None)]))


def finding_counts(checks: DataFrame, reference: str, finding: str) -> DataFrame:
    return checks.groupBy(reference, finding).agg(F.count(F.lit(1)).alias("n"))


# -- manifests and acquisition ---------------------------------------------------------------------------------------------------------


def manifest_values(provenance: DataFrame, dataset: str, fields: Sequence[str]) -> DataFrame:
    """dataset, field, value: the distinct values of each field as text; a row each, however many there are."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return provenance.select(dataset, each.alias("x")).select(dataset, "x.*").where("value IS NOT NULL").distinct()


def manifest_counts(provenance: DataFrame, dataset: str, group: str, digest: str, share_alike: Column, attribution: Column) -> DataFrame:
    """dataset, n_files, n_groups, n_digests, share_alike (any file asks for it), n_attributed."""
    n = F.count(F.lit(1)).alias("n_files")
    return provenance.groupBy(dataset).agg(n, F.count_distinct(group).alias("n_groups"), F.count_distinct(digest).alias("n_digests"), F.coalesce(F.bool_or(share_alike), F.lit(False)).alias("share_alike"), F.count_if(attribution).alias("n_attributed"))


def acquisition_plan(items: DataFrame, described: DataFrame, registry: DataFrame, batch: str, title: str, budget: int) -> DataFrame:
    """batch, title, status, why, size_bytes for each item asked for.

    described: title, image_id, size_bytes, accepted, why; of several descriptions of a title the smallest in that order counts. An item that the source does not have, or that is not accepted, is rejected; one in the registry is
    already there; the rest is planned, unless the batch's planned bytes pass the budget: then all of them are rejected together.
    """
    one = described.groupBy(title).agg(F.min(F.struct("image_id", "size_bytes", "accepted", "why")).alias("m")).select(title, "m.*", F.lit(True).alias("__described"))
    there = registry.select("image_id").distinct().withColumn("__there", F.lit(True))
    j = items.select(batch, title).join(one, title, "left").join(there, "image_id", "left")
    refused = F.when(F.col("__described").isNull(), "not found at the source").when(~F.coalesce("accepted", F.lit(False)), F.coalesce("why", F.lit("refused")))
    status = F.when(refused.isNotNull(), "rejected").when(F.col("__there"), "already_present").otherwise("planned")
    j = j.select(batch, title, status.alias("__status"), refused.alias("__why"), F.coalesce("size_bytes", F.lit(0)).cast("bigint").alias("size_bytes"))
    total = j.groupBy(batch).agg(F.sum(F.when(F.col("__status") == "planned", F.col("size_bytes"))).alias("__total"))
    j = j.join(broadcast_if_small(total), batch)
    over = (F.col("__status") == "planned") & (F.col("__total") > budget)
    return j.select(batch, title, F.when(over, "rejected").otherwise(F.col("__status")).alias("status"), F.when(over, "batch over budget").otherwise(F.col("__why")).alias("why"), "size_bytes")


def acquisition_report(plan: DataFrame, batch: str) -> DataFrame:
    """batch, status, n, n_bytes."""
    return plan.groupBy(batch, "status").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("n_bytes"))


def source_image_id(source: Column, record_id: Column, prefixes: Mapping[str, str], other: str = "src") -> Column:
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv]) if prefixes else F.create_map().cast("map<string,string>")
    return F.concat_ws("_", F.coalesce(F.try_element_at(table, source), F.lit(other)), record_id.cast("string"))


def unsafe_file_name(name: Column) -> Column:
    """Whether a name could leave its folder or hide in it. No name is unsafe."""
    return F.coalesce(name.rlike(r"[/\\]") | name.startswith(".") | (name == ""), F.lit(True))
