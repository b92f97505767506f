"""Filled worksheets and checklists back into rows: cells are parsed by expressions that give a value and a problem, and a sheet goes in whole or not at all.

A sheet is a table of text cells with ``row``, its line in the file; headers are matched before ' ('. What is wrong is told by row and column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions.scalars import present
from curata.operators.dating import STRENGTH
from curata.operators.publication import Refused
from curata.plans.storage import broadcast_if_small
from curata.plans.versions import Published

# How cells are written, and what their words stand for.
COUNT, YEARS = r"^\d+$", r"^\s*(-?\d{1,4})\s*(?:\.\.|to)\s*(-?\d{1,4})\s*$"
NUMBER = r"\s*([0-9.]+)\s*"
REGION = rf"^{NUMBER},{NUMBER},{NUMBER},{NUMBER}\s([a-z_]+)(?:\s+#(\d+))?(?:\s+'([^']*)')?\s*$"
ASSOCIATION = {"object": "direct", "context only": "same_context_insecure", "context": "same_context_insecure", "neither": "not_established"}
INSUFFICIENT, OPEN, OWN, REVIEW = "insufficient evidence", "-", "this_annotator", "review_state"
PLACED = ("stratigraphy", "absolute_dating")
#: Answers that all rows of one object must share.
SHARED = (
    "object_status", "inscription_present", "script_type", "script_confidence", "inscription_type", "reading_completeness", "reading", "reading_confidence", "interpretation_type", "translation", "translation_source", "translation_confidence",
)
#: Answers of a row alone.
OTHER = ("characters_visible", "alternative_readings", "regions", "dating_evidence", "dating_object_or_context", "dating_range", "dating_confidence", "references", "usable_for_annotation", "uncertainty_notes", REVIEW)
KEYS = ("artifact_id", "image_id", "annotator_id")
PROBLEM = "row long, column string, problem string"


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file's cells as text, with ``row``: its line among all, the header being the first. A mark at the start that says UTF-8 is no part of the first header. Rows are numbered in the order of their files, which are sheets and small."""
    cells = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    named = cells.select(*[F.col(f"`{c}`").alias(c.lstrip("\ufeff")) for c in cells.columns])
    order = F.monotonically_increasing_id()
    return named.withColumn("row", order + 2)


def named(sheet: DataFrame, columns: Sequence[str]) -> DataFrame:
    """row and the trimmed cells of ``columns``, empty where the sheet has no such column or says nothing."""
    there = {c.split(" (")[0].strip(): c for c in reversed(sheet.columns) if c != "row"}
    return sheet.select("row", *[(F.trim(F.coalesce(F.col(f"`{there[c]}`").cast("string"), F.lit(""))) if c in there else F.lit("")).alias(c) for c in columns])


def parts(cell: Column, mark: str) -> Column:
    return F.filter(F.transform(F.split(cell, mark), lambda x: F.trim(x)), lambda x: x != "")


def years(cell: Column) -> Column:
    """struct(start, end, problem) of 'start..end' in signed years; nothing of an empty cell."""
    year = lambda i: F.regexp_extract(cell, YEARS, i).try_cast("int")
    return F.struct(year(1).alias("start"), year(2).alias("end"), F.when((cell != "") & ~cell.rlike(YEARS), F.concat(F.lit("not start..end in signed years: "), cell)).alias("problem"))


def regions(cell: Column, image: Column) -> Column:
    """struct(value, note): 'x,y,w,h label [#sign] ['reading']' separated by ';'. A cell with any other part is a note as a whole."""
    each = parts(cell, ";")
    read = F.forall(each, lambda p: p.rlike(REGION))
    side = lambda p, i: F.regexp_extract(p, REGION, i).try_cast("double")
    one = lambda p: F.struct(
        image.alias("image_id"), *[side(p, i).alias(n) for i, n in enumerate(("x", "y", "width", "height"), 1)], F.regexp_extract(p, REGION, 5).alias("label"),
        F.regexp_extract(p, REGION, 6).try_cast("int").alias("sign_index"), F.nullif(F.regexp_extract(p, REGION, 7), F.lit("")).alias("sign_reading"),
    )
    whole = F.transform(each, one)
    return F.struct(F.when(read, whole).otherwise(F.slice(whole, 1, 0)).alias("value"), F.when(~read, cell).alias("note"))


def evidence(cell: Column, association: Column, types: Sequence[str] = tuple(STRENGTH)) -> Column:
    """struct(value, problem): 'type; observation; start..end or -; source' separated by '|'; the first wrong item is the problem, and then there is no value."""
    each = parts(cell, r"\|")
    said = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ASSOCIATION.items() for x in kv]), F.lower(association)), F.when(association == "", F.lit("not_established")).otherwise(association))

    def one(part: Column, i: Column) -> Column:
        bits = F.transform(F.split(part, ";"), lambda x: F.trim(x))
        kind, range_ = F.get(bits, F.lit(0)), F.get(bits, F.lit(2))
        bounds = years(F.when(range_ == OPEN, F.lit("")).otherwise(F.coalesce(range_, F.lit(""))))
        why = (
            F.when(F.size(bits) != 4, F.lit("not 'type; observation; start..end or -; source'")).when(~kind.isin(*types), F.concat(F.lit("unknown evidence type "), kind)).otherwise(bounds["problem"])
        )
        return F.struct(
            F.concat(F.lit("E"), (i + 1).cast("string")).alias("evidence_id"), kind.alias("evidence_type"), F.get(bits, F.lit(1)).alias("observation"), F.coalesce(F.nullif(F.get(bits, F.lit(3)), F.lit("")), F.lit("annotator_observation")).alias("source_reference"),
            bounds["start"].alias("start"), bounds["end"].alias("end"), F.when(kind.isin(*PLACED), said).alias("association"), F.concat(F.lit("item "), (i + 1).cast("string"), F.lit(": "), why).alias("problem"),
        )

    items = F.transform(each, one)
    wrong = F.get(F.filter(F.transform(items, lambda x: x["problem"]), lambda p: p.isNotNull()), F.lit(0))
    sound = F.transform(items, lambda x: F.struct(*[x[n].alias(n) for n in ("evidence_id", "evidence_type", "observation", "source_reference", "start", "end", "association")]))
    return F.struct(F.when(wrong.isNull(), sound).otherwise(F.slice(sound, 1, 0)).alias("value"), wrong.alias("problem"))


def citations(cell: Column) -> Column:
    """Array of struct(ref_id, locator): separated by ';' or ',', an id and what follows a space."""
    return F.transform(parts(cell, "[;,]"), lambda p: F.struct(F.regexp_extract(p, r"^\S+", 0).alias("ref_id"), F.nullif(F.trim(F.regexp_replace(p, r"^\S+", "")), F.lit("")).alias("locator")))


def alternatives(cell: Column) -> Column:
    """Array of struct(reading, source): 'reading (source)' separated by ';', the annotator's own without a source."""
    pattern = r"^(.*?)\s*\(([^)]+)\)\s*$"
    return F.transform(parts(cell, ";"), lambda p: F.when(p.rlike(pattern), F.struct(F.regexp_extract(p, pattern, 1).alias("reading"), F.regexp_extract(p, pattern, 2).alias("source"))).otherwise(F.struct(p.alias("reading"), F.lit(OWN).alias("source"))))


@dataclass
class Import:
    """rows: what would be written; problems: PROBLEM, none if the sheet may go in; skipped: rows that say nothing."""

    rows: DataFrame
    problems: DataFrame
    skipped: DataFrame


def import_worksheet(sheet: DataFrame, known: DataFrame, current: DataFrame, expert: bool = False, revise: bool = False, image_rows: int = 10_000) -> Import:
    """A row for each artifact and annotator of a filled sheet: artifact_id, annotator_id, supersedes, image_ids, the shared answers, start, end, confidence, regions, evidence, references, alternatives, usability.

    known: ref_id, status. current: artifact_id, annotator_id, annotation_id, which only a revision may supersede. Rows without an annotator and any answer are skipped. An artifact has as many rows as images: at most
    ``image_rows``, else a problem.
    """
    answers = (*SHARED, *OTHER)
    cells = named(sheet, [*KEYS, *answers])
    silent = F.col("annotator_id") == ""
    for a in answers:
        silent = silent & (F.col(a) == "")
    said = cells.where(~silent)
    count, ranged = F.col("characters_visible"), F.when(F.lower("dating_range") == INSUFFICIENT, F.lit("")).otherwise(F.col("dating_range"))
    read = said.select("*", years(ranged).alias("__years"), regions(F.col("regions"), F.col("image_id")).alias("__regions"), evidence(F.col("dating_evidence"), F.col("dating_object_or_context")).alias("__evidence"), citations(F.col("references")).alias("__cited"))
    told = lambda column, cond, what: F.when(cond, F.struct(F.lit(column).alias("column"), (what if isinstance(what, Column) else F.lit(what)).alias("problem")))
    checks = F.array_compact(F.array(
        told("annotator_id", F.col("annotator_id") == "", "answers without an annotator"), told("artifact_id", F.col("artifact_id") == "", "missing"), told("image_id", F.col("image_id") == "", "missing"),
        told("characters_visible", (count != "") & ~count.rlike(COUNT), F.concat(F.lit("no count: "), count)), told("dating_range", F.col("__years.problem").isNotNull(), F.col("__years.problem")),
        told("dating_evidence", F.col("__evidence.problem").isNotNull(), F.col("__evidence.problem")), told(REVIEW, (F.col(REVIEW) != "") & F.lit(not expert), "not for a project annotator"),
    ))
    wrong = read.select("row", F.explode(checks).alias("p")).select("row", "p.*")
    cited = read.select("row", "artifact_id", "annotator_id", F.posexplode("__cited").alias("pos", "c")).select("row", "artifact_id", "annotator_id", "pos", "c.*")
    resolved = cited.join(broadcast_if_small(known.select("ref_id", F.col("status").alias("__status"))), "ref_id", "left")
    wrong = wrong.unionByName(resolved.where("__status IS NULL").select("row", F.lit("references").alias("column"), F.concat(F.lit("unknown reference "), F.col("ref_id")).alias("problem")))
    group = ["artifact_id", "annotator_id"]
    whole = read.where("annotator_id <> '' AND artifact_id <> '' AND image_id <> ''")
    value = lambda a: F.nullif(F.col(a), F.lit(""))
    by = whole.groupBy(*group).agg(
        F.min("row").alias("row"), F.count(F.lit(1)).alias("__n"), *[F.count_distinct(value(a)).alias(f"__{a}") for a in SHARED], *[F.min(value(a)).alias(a) for a in SHARED],
        F.max_by(F.col("__years"), F.when(F.col("__years.start").isNotNull(), F.col("row"))).alias("__years"), F.max_by(value("dating_confidence"), F.when(F.col("dating_confidence") != "", F.col("row"))).alias("confidence"),
        F.min_by(F.col("__evidence.value"), F.when(F.size("__evidence.value") > 0, F.col("row"))).alias("evidence"), F.min_by(value(REVIEW), F.col("row")).alias(REVIEW),
    )
    apart = F.array_compact(F.array(*[told(a, F.col(f"__{a}") > 1, "differs between rows of one artifact") for a in SHARED], told("image_id", F.col("__n") > image_rows, "too many rows of one artifact")))
    wrong = wrong.unionByName(by.select("row", F.explode(apart).alias("p")).select("row", "p.*"))
    j = by.join(current.groupBy(*group).agg(F.max("annotation_id").alias("supersedes")), group, "left")
    if not revise:
        wrong = wrong.unionByName(j.where("supersedes IS NOT NULL").select("row", F.lit("annotator_id").alias("column"), F.concat(F.lit("has annotated this already: "), F.col("supersedes")).alias("problem")))
    few = whole.join(by.where(F.col("__n") <= image_rows).select(*group), group, "left_semi")
    gathered = few.groupBy(*group).agg(
        F.array_sort(F.collect_set("image_id")).alias("image_ids"), F.array_sort(F.collect_list(F.struct("row", F.col("__regions.value").alias("v")))).alias("__r"), F.array_sort(F.collect_set(F.struct("image_id", F.col("usable_for_annotation").alias("usable")))).alias("__u"),
        F.array_sort(F.flatten(F.collect_set(alternatives(F.col("alternative_readings"))))).alias("__a"),
    )
    refs = resolved.where("__status IS NOT NULL").groupBy(*group, "ref_id").agg(F.min_by(F.struct("locator", F.col("__status").alias("status")), F.struct("row", "pos")).alias("x"))
    refs = refs.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("ref_id", "x.locator", "x.status"))).alias("references"))
    rows = j.join(gathered, group).join(refs, group, "left").select(
        *group, "supersedes", "image_ids", *SHARED, REVIEW, F.col("__years.start").alias("start"), F.col("__years.end").alias("end"), "confidence", F.flatten(F.transform("__r", lambda x: x["v"])).alias("regions"), "evidence", "references",
        F.array_distinct("__a").alias("alternatives"), F.filter("__u", lambda x: x["usable"] != "").alias("usability"),
    )
    return Import(rows, wrong, cells.where(silent).select("row"))


def import_checklist(sheet: DataFrame, current: DataFrame, statuses: Sequence[str], defaults: Mapping[str, str]) -> Import:
    """A row for each checked claim of a checklist: ref_id, claim_id, status, the columns of ``defaults`` (with what a blank stands for) and ``supersedes``, the current record's id of the same reference and claim. current: ref_id, claim_id, verification_id."""
    cells = named(sheet, ["ref_id", "claim_id", "status", *defaults])
    checked = cells.where("status <> ''")
    full = checked.select("row", "ref_id", F.coalesce(F.nullif("claim_id", F.lit("")), F.lit("not_applicable")).alias("claim_id"), "status", *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)).alias(c) for c, v in defaults.items()])
    told = present((F.col("ref_id") == "", "ref_id: missing"), (~F.col("status").isin(*statuses), F.concat(F.lit("status: unknown "), F.col("status"))))
    wrong = full.select("row", F.explode(told).alias("p")).select("row", F.split_part("p", F.lit(":"), F.lit(1)).alias("column"), F.trim(F.substring_index("p", ":", -1)).alias("problem"))
    twice = full.where("ref_id <> ''").groupBy("ref_id", "claim_id").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("row")).where("n > 1")
    wrong = wrong.unionByName(twice.select("row", F.lit("claim_id").alias("column"), F.lit("checked twice in one sheet").alias("problem")))
    before = current.groupBy("ref_id", "claim_id").agg(F.max("verification_id").alias("supersedes"))
    return Import(full.join(before, ["ref_id", "claim_id"], "left"), wrong, cells.where("status = ''").select("row"))


def commit(imported: Import, table: Published, facts: Mapping[str, object] | None = None) -> int:
    """Appends an import's rows, or refuses it whole, naming a few of its problems; how many rows."""
    wrong = imported.problems.orderBy("row", "column").limit(5).collect()
    if wrong:
        raise Refused("; ".join(f"row {r.row}, {r.column}: {r.problem}" for r in wrong))
    table.publish(imported.rows, table.version(), append=True, facts={"action": "import", **(facts or {})})
    return imported.rows.count()
