"""Dating an object from its evidence: screening, a fold from the strongest evidence on, bounds, an outer bound where there is nothing else, confidence, categories, and positions that raters hold beside each other.

Bounds, counts and flags of an object are aggregates over its evidence with map-side combine. Only the fold is sequential: it streams over each object's usable
evidence in order, holding two numbers, so no object's evidence is gathered, and takes the other columns along, so none are joined back by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.functions import scalars as S
from curata.operators.evidence import CONFIDENCE
from curata.plans.storage import broadcast_if_small, ship

# Evidence types with their strength (1 the strongest) and the category they are reported in; sources that are the rater's own.
STRENGTH = {
    "stratigraphy": 1, "absolute_dating": 1, "associated_material": 2, "archaeological_context": 2, "palaeography": 3, "comparative_inscription": 3, "pottery_typology": 3, "linguistics": 4, "historical_reference": 4,
}
CATEGORY = {
    "stratigraphy": "archaeological_context", "absolute_dating": "absolute_dating", "associated_material": "object_context", "archaeological_context": "archaeological_context", "palaeography": "palaeographic",
    "comparative_inscription": "palaeographic", "pottery_typology": "object_context", "linguistics": "linguistic", "historical_reference": "publication_attribution",
}
OWN = ("annotator_observation", "this_annotator")
VERIFIED, PUBLICATION, UNCERTAIN = "verified_against_source", "publication_attribution", "uncertainty"
LAST = 9


def look_up(table: Mapping[str, object], key: Column, other: object) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(other))


def reference_infos(registry: DataFrame, cited: DataFrame) -> DataFrame:
    """ref_id, status: the registry's references, and cited ones that it lacks, for which a rater's word of verification counts as unverified."""
    own = registry.groupBy("ref_id").agg(F.max("status").alias("registered"))
    other = cited.groupBy("ref_id").agg(F.max(F.when(F.col("status") == VERIFIED, "unverified").otherwise(F.col("status"))).alias("claimed"))
    return own.join(other, "ref_id", "full_outer").select("ref_id", F.coalesce("registered", "claimed", F.lit("unverified")).alias("status"))


def narrowed(items: DataFrame, group: str, order: Sequence[str], start: Column, end: Column) -> DataFrame:
    """items and ``used``: in the given order of its group, each item with a bound narrows the range so far, or, if that would leave nothing, is not used; null for items without bounds, which don't count.

    All columns go with their items, so that none need be joined back. The window has whole groups sorted in one task, which then streams them; unlike a repartition it shuffles nothing where groups already lie together. State is the running range.
    """
    ship(items.sparkSession)
    if clash := {"__low", "__high", "__place", "used"} & {c.lower() for c in items.columns}:
        raise ValueError(f"columns of names that are used here: {', '.join(sorted(clash))}")
    rows = items.withColumns({"__low": start.cast("int"), "__high": end.cast("int")}).withColumn("__place", F.row_number().over(Window.partitionBy(group).orderBy(*order, "__low", "__high")))
    n, names = len(items.columns), [*items.columns, "used"]

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = None, None
        for b in batches:
            used = []
            for s, e, place in zip(*(b.column(n + i).to_pylist() for i in range(3)), strict=True):
                if place == 1:
                    low, high = None, None
                if s is None and e is None:
                    used.append(None)
                    continue
                new_low = low if s is None else s if low is None else max(low, s)
                new_high = high if e is None else e if high is None else min(high, e)
                fits = new_low is None or new_high is None or new_low <= new_high
                if fits:
                    low, high = new_low, new_high
                used.append(fits)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(used, pa.bool_())], names=names)

    return rows.mapInArrow(narrow, T.StructType([*items.schema.fields, T.StructField("used", T.BooleanType())]))


def fold(items: DataFrame, group: str, tier: str, item: str, start: str, end: str) -> DataFrame:
    """group, item, tier, start, end, used for items with a bound, in the order of (tier, item): each narrows the range so far, or, if that would leave nothing, is not used.

    Null bounds are open. Items are sorted within their groups and streamed; state is the running range. The order of equal (tier, item) is that of their bounds.
    """
    rows = items.where(F.col(group).isNotNull() & (F.col(start).isNotNull() | F.col(end).isNotNull())).select(group, item, F.col(tier).alias("tier"), F.col(start).cast("int").alias("start"), F.col(end).cast("int").alias("end"))
    return narrowed(rows, group, ["tier", item], F.col("start"), F.col("end"))


def estimate(df: DataFrame, group: str, tier: str, item: str, start: str, end: str) -> DataFrame:
    """group, state, start, end, display, used, conflicts: the folded range of every group, and the names of its items by what became of them, in order."""
    f = fold(df, group, tier, item, start, end)
    names = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("tier", item, "start", "end")))), lambda x: x[item].cast("string")), ",")
    g = f.groupBy(group).agg(F.max(F.when(F.col("used"), F.col("start"))).alias("start"), F.min(F.when(F.col("used"), F.col("end"))).alias("end"), names(F.col("used")).alias("used"), names(~F.col("used")).alias("conflicts"))
    j = df.select(group).where(F.col(group).isNotNull()).distinct().join(g, group, "left")
    dated = F.col("used").isNotNull()
    state, shown = F.when(dated, "estimated").otherwise("insufficient_evidence"), F.when(dated, S.span_label(F.col("start"), F.col("end"))).otherwise("Insufficient evidence")
    return j.select(group, state.alias("state"), "start", "end", shown.alias("display"), F.coalesce("used", F.lit("")).alias("used"), F.coalesce("conflicts", F.lit("")).alias("conflicts"))


def weigh(evidence: DataFrame, objects: DataFrame, references: DataFrame, group: str, item: str, secure: tuple[str, ...] = ("direct", "same_context_secure"), stratified: str = "excavated_stratified") -> DataFrame:
    """Each item of evidence with ``tier``, ``category``, ``ref_status`` (null for the rater's own and for unknown ones), ``excluded`` (null, or the first reason that bars it) and ``used`` (null where excluded).

    evidence: group, item (distinct in its group), evidence_type, provenance, association, source_reference, confidence, start, end. objects: group (once), context, script, script_provenance. references: ref_id (once), status.
    """
    refs = references.select(F.col("ref_id").alias("source_reference"), F.col("status").alias("ref_status"))
    j = evidence.join(objects.select(group, "context"), group, "left").join(broadcast_if_small(refs), "source_reference", "left")
    kind, own = F.col("evidence_type"), F.coalesce(F.col("source_reference").isin(*OWN), F.lit(False))
    outside = ~F.coalesce(F.col("association").isin(*secure), F.lit(False))
    why = (
        F.when(F.col("provenance") == "ai_prediction", "prediction").when(F.col("start").isNull() & F.col("end").isNull(), "no bounds").when(kind.isin("stratigraphy", "absolute_dating") & outside, "association not secure")
        .when((kind == "stratigraphy") & ~F.col("context").eqNullSafe(F.lit(stratified)), "context not stratified").when(~own & F.col("ref_status").isNull(), "unknown reference")
    )
    w = j.withColumns({"tier": look_up(STRENGTH, kind, LAST), "ref_status": F.when(~own, F.col("ref_status")), "excluded": why})
    counts = F.col("excluded").isNull() & F.col(group).isNotNull() & F.col(item).isNotNull()
    out = narrowed(w, group, ["tier", item], F.when(counts, F.col("start")), F.when(counts, F.col("end")))
    return out.withColumn("category", look_up(CATEGORY, kind, UNCERTAIN))


def estimate_dates(weighed: DataFrame, objects: DataFrame, group: str, script: str, earliest: int, stratified: str = "excavated_stratified", establishing: tuple[str, ...] = ("expert_annotation", "source_information")) -> DataFrame:
    """group, state, start, end, confidence, display, centuries, n_used, n_conflicts, n_excluded, one row for each object.

    A level is that which the kinds of evidence allow, or the best one of a used item (unknown the lowest; low where no item says a known word) if that is lower.
    estimated: the range of the used items. outer_bound_only: none, but the object's script is ``script`` by an establishing source: no earlier than ``earliest``. Else insufficient_evidence.
    """
    used = F.coalesce(F.col("used"), F.lit(False))
    on = lambda c: F.when(used, c)
    sound_ref = F.coalesce(F.col("source_reference").isin(*OWN), F.lit(False)) | F.col("ref_status").eqNullSafe(F.lit(VERIFIED))
    rank = F.nullif(F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence")), F.lit(0))
    g = weighed.groupBy(group).agg(
        F.max(on(F.col("start"))).alias("lo"), F.min(on(F.col("end"))).alias("hi"), F.count_if(used).alias("n_used"), F.count_if(~F.col("used")).alias("n_conflicts"), F.count_if(F.col("excluded").isNotNull()).alias("n_excluded"),
        F.min(on(F.col("evidence_type"))).alias("type0"), F.max(on(F.col("evidence_type"))).alias("type1"), F.min(on(F.col("tier"))).alias("tier"), F.bool_and(on(F.coalesce(F.col("provenance") == "expert_annotation", F.lit(False)))).alias("expert"),
        F.bool_and(on(sound_ref)).alias("verified"), F.max(on(rank)).cast("int").alias("best"),
    )
    j = objects.select(group, "context", "script", "script_provenance").join(g, group, "left").fillna(0, ["n_used", "n_conflicts", "n_excluded"])
    firm = F.col("expert") & F.coalesce(F.col("type0") < F.col("type1"), F.lit(False)) & (F.col("tier") <= 2) & (F.col("n_conflicts") == 0) & F.col("verified")
    low, moderate, high = (CONFIDENCE.index(x) + 1 for x in ("low", "moderate", "high"))
    top = F.when(~firm, low).when((F.col("tier") == 1) & F.col("context").eqNullSafe(F.lit(stratified)), high).otherwise(moderate)
    level = F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.least(top, F.coalesce("best", F.lit(low))))
    dated, bounded = F.col("n_used") > 0, F.col("script").eqNullSafe(F.lit(script)) & F.coalesce(F.col("script_provenance").isin(*establishing), F.lit(False))
    lo, hi = F.when(dated, F.col("lo")).when(bounded, F.lit(earliest)), F.when(dated, F.col("hi"))
    state = F.when(dated, "estimated").when(bounded, "outer_bound_only").otherwise("insufficient_evidence")
    shown = F.when(dated | bounded, S.span_label(lo, hi)).otherwise("Insufficient evidence")
    closed = dated & F.col("lo").isNotNull() & F.col("hi").isNotNull()
    return j.select(
        group, state.alias("state"), lo.cast("int").alias("start"), hi.cast("int").alias("end"), F.when(dated, level).when(bounded, "very_low").otherwise("unknown").alias("confidence"), shown.alias("display"),
        F.when(closed, S.centuries_label(lo, hi)).otherwise("").alias("centuries"), "n_used", "n_conflicts", "n_excluded")


def by_category(weighed: DataFrame, group: str) -> DataFrame:
    """group, category, n, n_used: evidence by what it is; what cites a publication counts under that too."""
    other = ~F.coalesce(F.col("source_reference").isin(*OWN), F.lit(False)) & (F.col("category") != PUBLICATION)
    kinds = F.explode(F.array_compact(F.array(F.col("category"), F.when(other, PUBLICATION))))
    return weighed.select(group, kinds.alias("category"), F.coalesce("used", F.lit(False)).alias("used")).groupBy(group, "category").agg(F.count(F.lit(1)).alias("n"), F.count_if("used").alias("n_used"))


def positions(log: DataFrame, item: str, kind: str, start: str, end: str, n_evidence: str) -> DataFrame:
    """Rows of human raters that take a position on the date: a bound, or evidence of their own."""
    return log.where(~F.col(kind).eqNullSafe(F.lit("ai_prediction")) & (F.col(start).isNotNull() | F.col(end).isNotNull() | (F.coalesce(F.col(n_evidence), F.lit(0)) > 0)))


def position_conflicts(stated: DataFrame, item: str, start: str, end: str) -> DataFrame:
    """item, n_ranges, conflict: whether stated ranges (with a bound) differ; they are not averaged."""
    some = F.col(start).isNotNull() | F.col(end).isNotNull()
    g = stated.groupBy(item).agg(F.count_distinct(F.when(some, F.struct(F.coalesce(F.col(start).cast("string"), F.lit("")), F.coalesce(F.col(end).cast("string"), F.lit(""))))).alias("n_ranges"))
    return g.withColumn("conflict", F.col("n_ranges") > 1)


def statements(dates: DataFrame, status: DataFrame, conflicts: DataFrame, readings: DataFrame, group: str) -> DataFrame:
    """group, confidence, statements: an object's summary. Disputes come first; conflicting positions and disagreement cap the confidence at low.

    status: group, status. conflicts: group, conflict. readings: group, script_known, reading_known, completeness, n_alternatives.
    """
    j = dates.select(group, "state", "confidence").join(status.select(group, "status"), group, "left").join(conflicts.select(group, "conflict"), group, "left").join(readings, group, "left")
    apart, open_date = F.coalesce("conflict", F.lit(False)), F.col("state") == "insufficient_evidence"
    script, reading = F.coalesce("script_known", F.lit(False)), F.coalesce("reading_known", F.lit(False))
    nothing = ~script & ~reading & open_date
    said = S.present(
        (F.col("status") == "disputed", "disputed"), (F.col("status") == "project_disagreement", "raters disagree"), (nothing, "insufficient evidence"), (~reading & (F.col("completeness") == "illegible"), "illegible"),
        (reading & F.col("completeness").isin("partial", "fragmentary"), F.col("completeness")), (reading & (F.col("n_alternatives") > 0), "alternative readings"), (apart, "conflicting dates"), (open_date & ~nothing, "dating: insufficient evidence"),
    )
    cap = (apart | F.coalesce(F.col("status").isin("disputed", "project_disagreement"), F.lit(False))) & F.col("confidence").isin("moderate", "high")
    return j.select(group, F.when(cap, "low").otherwise(F.col("confidence")).alias("confidence"), F.array_join(said, "; ").alias("statements"))
