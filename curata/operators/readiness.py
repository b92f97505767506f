"""Detection by threshold and by class, readiness gates, workflow stages, and checks of generated data sets. Counts are aggregates; a report is a table of a few rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.operators.evidence import gates
from curata.operators.reports import tally


def _prf(tp: Column, fp: Column, fn: Column, undefined: float | None) -> dict[str, Column]:
    """precision, recall and F1; ``undefined`` where nothing was found, or nothing was there."""
    share = lambda n: F.coalesce(F.try_divide(tp.cast("double"), n.cast("double")), F.lit(undefined).cast("double"))
    p, r = share(tp + fp), share(tp + fn)
    return {"precision": p, "recall": r, "f1": F.when(p.isNotNull() & r.isNotNull(), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))}


def _sizes(boxes: DataFrame, image: str, name: str) -> DataFrame:
    return boxes.groupBy(image).agg(F.count(F.lit(1)).alias(name))


def _by_image(images: DataFrame, matches: DataFrame, pred: DataFrame, truth: DataFrame, image: str) -> DataFrame:
    j = images.join(_sizes(truth, image, "n_truth"), image, "left").join(_sizes(pred, image, "n_pred"), image, "left").join(matches, image, "left")
    return j.fillna(0, ["n_truth", "n_pred", *[c for c in matches.columns if c != image]])


def detection_by_threshold(images: DataFrame, matches: DataFrame, pred: DataFrame, truth: DataFrame, image: str, thresholds: Sequence[float] = (0.5, 0.75)) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1 (null where undefined), mean_iou, n_missed_images over the images that were judged; an image without truth counts its predictions as false.

    ``matches`` are one-to-one at the lowest threshold, by falling IoU: those of a higher one are the ones among them that reach it, since a weaker candidate never comes first.
    """
    per = [x for i, t in enumerate(thresholds) for x in (F.count_if(F.col("iou") >= t).alias(f"m{i}"), F.coalesce(F.sum(F.when(F.col("iou") >= t, F.col("iou"))), F.lit(0.0)).alias(f"s{i}"))]
    j = _by_image(images.select(image).distinct(), matches.groupBy(image).agg(*per), pred, truth, image)
    sums = j.agg(F.sum("n_pred").alias("p"), F.sum("n_truth").alias("t"), *[x for i in range(len(thresholds)) for x in (F.sum(f"m{i}").alias(f"m{i}"), F.sum(f"s{i}").alias(f"s{i}"), F.count_if(F.col(f"m{i}") < F.col("n_truth")).alias(f"x{i}"))])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"m{i}").alias("tp"), (F.col("p") - F.col(f"m{i}")).alias("fp"), (F.col("t") - F.col(f"m{i}")).alias("fn"), F.col(f"s{i}").alias("s"), F.col(f"x{i}").alias("n_missed_images")) for i, t in enumerate(thresholds)])
    r = sums.select(F.explode(rows).alias("x")).select("x.*")
    return r.withColumns(_prf(F.col("tp"), F.col("fp"), F.col("fn"), None)).withColumn("mean_iou", F.try_divide(F.col("s"), F.col("tp").cast("double"))).drop("s")


def detection_by_class(images: DataFrame, matches: DataFrame, pred: DataFrame, truth: DataFrame, image: str, label: str) -> DataFrame:
    """label, n_images, tp, fp, fn, precision, recall, f1 (0 where undefined), alarm_rate: the share of the class's images with any prediction, a false alarm rate for a class without marks. images: image (once), label."""
    j = _by_image(images, matches.groupBy(image).agg(F.count(F.lit(1)).alias("m")), pred, truth, image)
    g = j.groupBy(label).agg(F.count(F.lit(1)).alias("n_images"), F.sum("m").alias("tp"), F.sum(F.col("n_pred") - F.col("m")).alias("fp"), F.sum(F.col("n_truth") - F.col("m")).alias("fn"), F.avg((F.col("n_pred") > 0).cast("double")).alias("alarm_rate"))
    return g.withColumns(_prf(F.col("tp"), F.col("fp"), F.col("fn"), 0.0))


# -- gates and stages ------------------------------------------------------------------------------------------------------------------


def _one_row(numbers: DataFrame, names: Sequence[str]) -> DataFrame:
    return numbers.agg(*[F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("n"))), F.lit(0)).alias(m) for m in names])


def readiness_gates(
    records: DataFrame, findings: DataFrame, refused: DataFrame, images: DataFrame, split_errors: DataFrame, classes: Sequence[str], least: int, canonical: bool,
    group: str, label: str, label_source: str, usable: str, eligible: Column,
) -> DataFrame:
    """gate_no, gate, result for G1 to G11: PASS, FAIL, or NOT_EVALUATED without records (but for the first three). What is not evaluated counts as failed.

    findings: rule, severity. refused: records that the loader refuses. images: files. split_errors: what a manifest's check finds, or one row where there is none.
    """
    e = F.coalesce(eligible, F.lit(False))
    rows = tally(records, [(F.lit(True), "records", None), (e, "eligible", None), (e & (F.coalesce(F.col(label_source), F.lit("unknown")) == "unknown"), "unsourced", None), (e & ~F.col(usable).eqNullSafe(F.lit("yes")), "unusable", None)])
    errors = tally(findings, [(F.col("severity") == "error", "errors", None), (F.col("rule") == "R4", "shared", None)])
    others = [tally(df, [(F.lit(True), name, None)]) for df, name in ((refused, "refused"), (images, "images"), (split_errors, "split"))]
    groups = records.where(F.col(label).isin(*classes) & F.col(group).isNotNull()).groupBy(label).agg(F.count_distinct(group).alias("m"))
    sized = tally(groups, [(F.lit(True), "present", None), (F.col("m") >= least, "enough", None)])
    names = ["records", "eligible", "unsourced", "unusable", "errors", "shared", "refused", "images", "split", "present", "enough"]
    one = _one_row(reduce(DataFrame.unionByName, [errors, *others, sized], rows), names)
    n, any_record = F.col, F.col("records") > 0
    some, yes = any_record & (F.col("eligible") > 0), F.lit(True)
    return gates(one, [
        ("canonical source", yes, F.lit(canonical)), ("records exist", yes, any_record), ("image files exist", yes, n("images") > 0), ("validation passes", any_record, n("errors") == 0), ("every record loads", any_record, n("refused") == 0),
        ("no photograph under two groups", any_record, n("shared") == 0), ("labels have a source", any_record, some & (n("unsourced") == 0)), ("use is permitted", any_record, some & (n("unusable") == 0)),
        ("every class is present", any_record, n("present") == len(set(classes))), ("enough groups a class", any_record, n("enough") == len(set(classes))), ("verified split", any_record, n("split") == 0),
    ])


def workflow_stages(numbers: DataFrame) -> DataFrame:
    """gate_no, gate, result for the eleven stages from raw data to evaluation: PASS, BLOCKED (a machine's work) or WAITING (a person's). The first that does not pass is the current one (evidence.current_stage).

    numbers: metric, n; those not given are 0.
    """
    names = ["records", "present", "no_provenance", "other_digest", "schema_errors", "hash_errors", "undecoded", "store_errors", "humans", "round_items", "round_complete", "pairs", "candidates", "split_ok", "ready", "experiments"]
    one = _one_row(numbers, names)
    n = F.col
    some = n("records") > 0
    blocked = lambda ok: F.when(ok, "PASS").otherwise("BLOCKED")
    waiting = lambda ok: F.when(ok, "PASS").otherwise("WAITING")
    stages = [
        ("raw data", blocked(some & (n("present") == n("records")))), ("provenance", blocked(some & (n("no_provenance") + n("other_digest") == 0))), ("schema", blocked(some & (n("schema_errors") == 0))),
        ("image hashes", blocked(some & (n("hash_errors") == 0))), ("preprocessing", blocked((n("present") > 0) & (n("undecoded") == 0))), ("annotations", F.when(n("store_errors") > 0, "BLOCKED").otherwise(waiting(n("humans") > 0))),
        ("expert agreement", waiting((n("round_complete") == n("round_items")) & (n("pairs") > 0))), ("promotion", waiting(n("candidates") > 0)), ("split", waiting(n("split_ok") > 0)), ("training", waiting(n("ready") > 0)),
        ("evaluation", waiting((n("experiments") > 0) & (n("ready") > 0))),
    ]
    table = [F.struct(F.lit(i).alias("gate_no"), F.lit(name).alias("gate"), state.alias("result")) for i, (name, state) in enumerate(stages, 1)]
    return one.select(F.explode(F.array(*table)).alias("x")).select("x.*")


# -- generated data sets ---------------------------------------------------------------------------------------------------------------


def generated_findings(records: DataFrame, files: DataFrame, presence: Mapping[str, str], malformed: Column, target: Column) -> DataFrame:
    """rule, record, group: what is wrong with generated records. ``index`` is distinct; the first row of an id or a digest owns it.

    S1 malformed; S2 a repeated id, or one that does not begin with its group; S3 a file that is missing or has another digest (files: path, once, digest); S4 a digest seen before;
    S5 a group of several labels (no record); S6 presence that its label does not have; S7 a stored target that is not ``target``, the one computed anew.
    Columns of records: index, record, group, label, present, digest, path, target. Owners are aggregates joined back, so a copied digest is no window over its rows.
    """
    first = lambda key: records.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("index").alias(f"__first_{key}"))
    j = records.join(first("record"), "record", "left").join(first("digest"), "digest", "left").join(files.select("path", F.col("digest").alias("__file"), F.lit(True).alias("__there")), "path", "left")
    table = F.create_map(*[F.lit(x) for kv in presence.items() for x in kv])
    should = F.try_element_at(table, F.col("label"))
    found = [
        (malformed, "S1"), (F.col("index") > F.col("__first_record"), "S2"), (~F.coalesce(F.startswith("record", F.concat("group", F.lit("-V"))), F.lit(True)), "S2"),
        (F.col("path").isNotNull() & (F.col("__there").isNull() | (F.col("__file") != F.col("digest"))), "S3"), (F.col("index") > F.col("__first_digest"), "S4"),
        (should.isNotNull() & ~F.col("present").eqNullSafe(should), "S6"), (target.isNotNull() & ~F.col("target").eqNullSafe(target), "S7"),
    ]
    rules = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in found]), lambda x: x.isNotNull())
    rows = j.select(F.explode(rules).alias("rule"), "record", "group")
    labels = records.where(F.col("group").isNotNull()).groupBy("group").agg(F.count_distinct(F.coalesce("label", F.lit(""))).alias("m")).where("m > 1")
    return rows.unionByName(labels.select(F.lit("S5").alias("rule"), F.lit(None).cast(records.schema["record"].dataType).alias("record"), "group"))


def partition_overlaps(df: DataFrame, partition: str, key: str) -> DataFrame:
    """part_a, part_b, n: keys that two partitions share, each pair once. Pairs are made within a key's distinct partitions, of which there are few."""
    g = df.where(F.col(key).isNotNull() & F.col(partition).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(partition)).alias("ps")).where(F.size("ps") > 1)
    pairs = F.flatten(F.transform("ps", lambda a: F.transform(F.filter("ps", lambda b: b > a), lambda b: F.struct(a.alias("part_a"), b.alias("part_b")))))
    return g.select(F.explode(pairs).alias("x")).groupBy("x.part_a", "x.part_b").agg(F.count(F.lit(1)).alias("n"))


def file_differences(recorded: DataFrame, present: DataFrame, path: str) -> DataFrame:
    """path, problem: unrecorded (there, in no record) or missing (in a record, not there): both ways."""
    a, b = recorded.select(path).distinct().withColumn("__r", F.lit(True)), present.select(path).distinct().withColumn("__p", F.lit(True))
    return a.join(b, path, "full_outer").select(path, F.when(F.col("__r").isNull(), "unrecorded").when(F.col("__p").isNull(), "missing").alias("problem")).where("problem IS NOT NULL")


def generated_checks(findings: DataFrame, records: DataFrame, differences: DataFrame, overlaps: DataFrame, foreign: Mapping[str, DataFrame], per_class: int, version: str, locked: DataFrame | None = None, anew: DataFrame | None = None) -> DataFrame:
    """check, n, passed: V1 to V3 traces of generated data elsewhere (``foreign``: files, records, annotations), V4 to V8 findings by rule, V9 classes that do not have ``per_class`` groups, V10 files, V11 partitions that overlap, V13 records of another version; given what differs from the lock and what was not made again the same (operators.generated), V12 and V14 as well.

    Columns of records: group, label, version.
    """
    rules = {"V4": ["S1"], "V5": ["S2"], "V6": ["S3"], "V7": ["S4"], "V8": ["S5", "S6"]}
    made = tally(findings, [(F.col("rule").isin(*r), v, None) for v, r in rules.items()])
    classes = records.groupBy("label").agg(F.count_distinct("group").alias("m"))
    parts = [tally(classes, [(F.col("m") != per_class, "V9", None)]), tally(differences, [(F.lit(True), "V10", None)]), tally(overlaps, [(F.lit(True), "V11", None)]), tally(records, [(~F.col("version").eqNullSafe(F.lit(version)), "V13", None)])]
    parts += [tally(df, [(F.lit(True), v, None)]) for v, df in zip(("V1", "V2", "V3"), (foreign[k] for k in ("files", "records", "annotations")), strict=True)]
    given = [(v, df) for v, df in (("V12", locked), ("V14", anew)) if df is not None]
    parts += [tally(df, [(F.lit(True), v, None)]) for v, df in given]
    names = ["V1", "V2", "V3", *rules, "V9", "V10", "V11", *(v for v, _ in given if v == "V12"), "V13", *(v for v, _ in given if v == "V14")]
    one = _one_row(reduce(DataFrame.unionByName, parts, made), names)
    return one.select(F.explode(F.array(*[F.struct(F.lit(v).alias("check"), F.col(v).alias("n"), (F.col(v) == 0).alias("passed")) for v in names])).alias("x")).select("x.*")
