"""Rule families of the annotation store, the knowledge base, its verification records and prechecks, and small relational helpers around them.

Each family is one projection to an array of rule names (exploded to rows by ``problems``), plus grouped checks where rows meet. Inputs are typed tables;
missing optional columns are columns of nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.functions import absence as A
from curata.functions import scalars as S
from curata.plans.storage import broadcast_if_small

# The role that each kind of annotation comes from; statuses that a check can have.
ROLE = {"source_information": "project_annotator", "project_annotation": "project_annotator", "expert_annotation": "expert", "ai_prediction": "ai_model"}
VERIFIED = "verified_against_source"
NA = "not_applicable"


def c(name: str) -> Column:
    return F.col(name)


def problems(df: DataFrame, id_col: str, checks: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """id, rule, what for every (rule, what, condition) that holds; a null condition does not hold."""
    items = [F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(what).alias("what"))) for rule, what, cond in checks]
    return df.select(c(id_col).alias("id"), F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("p")).select("id", "p.*")


def repeated(df: DataFrame, id_col: str, rule: str) -> DataFrame:
    return df.where(c(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(c(id_col).alias("id"), F.lit(rule).alias("rule"), F.lit("duplicate id").alias("what"))


def synthetic_reasons(prefix: str, source: str, label_source: str, labels: Sequence[str], marker: str, columns: Sequence[str]) -> Column:
    """Why a record is generated data (an array; empty where it is not). Columns that the table lacks count as null."""
    col = lambda n: c(n) if n in columns else F.lit(None).cast("string")
    starts = lambda x: F.upper(x).startswith(prefix)
    path = F.lower(F.replace(col("image_path"), F.lit("\\"), F.lit("/")))
    images = F.exists(c("image_ids"), starts) if "image_ids" in columns else F.lit(False)
    return S.present(
        (col("dataset_type") == "synthetic", "dataset_type"), *[(starts(col(k)), k) for k in ("artifact_id", "image_id", "catalogue_number")], (images, "image_ids"),
        (F.coalesce(col("source") == source, F.lit(False)) | F.coalesce(col("label_source") == label_source, F.lit(False)), "source"), (path.contains("synthetic/") | starts(F.element_at(F.split(path, "/"), -1)), "image_path"),
        (col("script_type").isin(*labels), "script_type"), (F.coalesce(col("synthetic_marker") == marker, F.lit(False)) | F.coalesce(col("notes") == marker, F.lit(False)), "marker"),
    )


# -- annotations -----------------------------------------------------------------------------------------------------------------


def real(x: Column) -> Column:
    return A.has_real_text(x)


def stated(x: Column) -> Column:
    return ~F.coalesce(x, F.lit("unknown")).isin("unknown", NA)


def annotation_problems(a: DataFrame, known_refs: DataFrame | None = None, artifact_images: DataFrame | None = None, verified_refs: DataFrame | None = None) -> DataFrame:
    """id, rule, what for N2 to N10, N12 to N15 and N18 to N20.

    Columns: annotation_id, artifact_id, image_ids, provenance_type, role, qualification, review_state, inscription (struct), interpretation (struct), dating (struct), references, image_usability, adjudication, ai_marked. known_refs: ref_id; artifact_images: artifact_id,
    image_id; verified_refs: ref_id.
    """
    i, t, d = (lambda n: c(f"inscription.{n}")), (lambda n: c(f"interpretation.{n}")), (lambda n: c(f"dating.{n}"))
    ev, adj = d("dating_evidence"), c("adjudication")
    none = F.coalesce(F.size(ev), F.lit(0)) <= 0
    basis = F.filter(d("dating_basis"), lambda b: ~b.isin(*A.SENTINELS))
    ranged = d("estimated_start_year").isNotNull() | d("estimated_end_year").isNotNull()
    present, script = i("inscription_present"), i("script_type")
    signs = F.transform(F.filter(i("regions"), lambda r: (r["label"] == "character") & r["sign_index"].isNotNull()), lambda r: F.struct(r["image_id"], r["sign_index"]))
    checks = [
        ("N3", "region on another image", F.exists(i("regions"), lambda r: ~F.array_contains(c("image_ids"), r["image_id"]))),
        ("N3", "region beyond the image", F.exists(i("regions"), lambda r: (r["x"] + r["width"] > 1 + 1e-9) | (r["y"] + r["height"] > 1 + 1e-9))),
        ("N4", "role", ~c("role").eqNullSafe(F.element_at(F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv]), c("provenance_type")))),
        ("N4", "expert_reviewed is for experts", (c("review_state") == "expert_reviewed") & (c("provenance_type") != "expert_annotation")),
        ("N4", "predictions are unreviewed", (c("provenance_type") == "ai_prediction") & (c("review_state") != "unreviewed")),
        ("N5", "source information cites", (c("provenance_type") == "source_information") & (F.coalesce(F.size("references"), F.lit(0)) <= 0)),
        ("N6", "absent needs script none", (present == "no") & (script != "none")), ("N6", "absent needs type not_applicable", (present == "no") & (i("inscription_type") != NA)),
        ("N6", "absent needs reading not_applicable", (present == "no") & (i("reading") != NA)), ("N6", "absent with regions", (present == "no") & (F.size(i("regions")) > 0)),
        ("N6", "none needs absent", (script == "none") & (present != "no")), ("N6", "not examined with a script", (present == "unknown") & (script != "unknown")),
        ("N6", "script without confidence", (script != "unknown") & ~stated(i("script_confidence"))),
        ("N7", "reading where nothing is present", real(i("reading")) & ~present.isin("yes", "uncertain")), ("N7", "reading without source", real(i("reading")) & ~real(i("reading_source"))),
        ("N7", "reading without confidence", real(i("reading")) & ~stated(i("reading_confidence"))), ("N7", "interpretation without reading", ~real(i("reading")) & ~t("interpretation_type").isin("unknown", NA, "uncertain")),
        ("N7", "translation without reading", ~real(i("reading")) & real(t("translation"))),
        ("N8", "a name is not translated", (t("interpretation_type") == "personal_name") & (t("translation") != NA)), ("N8", "type without translation", t("interpretation_type").isin("symbol", "not_translatable") & real(t("translation"))),
        ("N8", "translation without source", real(t("translation")) & ~real(t("translation_source"))), ("N8", "translation without confidence", real(t("translation")) & ~stated(t("translation_confidence"))),
        ("N9", "range reversed", d("estimated_start_year") > d("estimated_end_year")), ("N9", "range without evidence", ranged & none), ("N9", "range without basis", ranged & (F.coalesce(F.size(basis), F.lit(0)) <= 0)),
        ("N9", "range without confidence", ranged & ~stated(d("dating_confidence"))), ("N9", "confidence without range", ~ranged & none & stated(d("dating_confidence"))), ("N9", "basis without evidence", none & (F.size(basis) > 0)),
        ("N9", "basis names other evidence", F.size(F.array_except(basis, F.transform(ev, lambda e: e["evidence_type"]))) > 0), ("N9", "evidence id twice", F.size(F.array_distinct(F.transform(ev, lambda e: e["evidence_id"]))) < F.size(ev)),
        ("N9", "evidence reversed", F.exists(ev, lambda e: e["supports_start_year"] > e["supports_end_year"])),
        ("N9", "evidence without association", F.exists(ev, lambda e: e["evidence_type"].isin("stratigraphy", "absolute_dating") & e["association"].isNull())),
        ("N10", "reference twice", F.size(F.array_distinct(F.transform("references", lambda r: r["ref_id"]))) < F.size("references")),
        ("N13", "usability of another image", F.exists("image_usability", lambda u: ~F.array_contains(c("image_ids"), u["image_id"]))),
        ("N15", "marked as prepared by a model", c("ai_marked") & (c("provenance_type") != "ai_prediction")),
        ("N18", "adjudicator is no expert", adj.isNotNull() & ~((c("provenance_type") == "expert_annotation") & (c("review_state") == "expert_reviewed"))), ("N18", "no qualification", adj.isNotNull() & ~real(c("qualification"))),
        ("N18", "resolves itself", F.array_contains(adj["resolves"], c("annotation_id"))), ("N18", "insufficient evidence asserts a script", (adj["outcome"] == "insufficient_evidence") & ~script.isin("uncertain", "unknown")),
        ("N19", "character without index", F.exists(i("regions"), lambda r: (r["label"] == "character") & r["sign_index"].isNull())), ("N19", "index twice", F.size(F.array_distinct(signs)) < F.size(signs)),
        ("N19", "characters where nothing is present", F.exists(i("regions"), lambda r: r["label"] == "character") & ~present.isin("yes", "uncertain")),
        ("N19", "index on another region", F.exists(i("regions"), lambda r: (r["label"] != "character") & r["sign_index"].isNotNull())),
        ("N20", "illegible with a reading", (i("reading_completeness") == "illegible") & real(i("reading"))), ("N20", "complete without a reading", i("reading_completeness").isin("complete", "partial", "fragmentary") & ~real(i("reading"))),
        ("N20", "completeness where nothing is present", stated(i("reading_completeness")) & (present == "no")),
    ]
    out = problems(a, "annotation_id", checks).unionByName(repeated(a, "annotation_id", "N12"))
    if artifact_images is not None:
        known = artifact_images.groupBy("artifact_id").agg(F.collect_set("image_id").alias("__known"))
        j = a.join(known, "artifact_id", "left")
        out = out.unionByName(problems(j, "annotation_id", [("N2", "unknown artifact", c("__known").isNull()), ("N2", "image of another artifact", F.size(F.array_except("image_ids", "__known")) > 0)]))
    cites = a.select("annotation_id", F.transform("references", lambda r: r["ref_id"]).alias("own"), F.explode(F.concat(F.array(i("reading_source"), t("translation_source")), F.coalesce(F.transform(ev, lambda e: e["source_reference"]), F.array().cast("array<string>")))).alias("ref_id"))
    cites = cites.where(real(c("ref_id")) & ~c("ref_id").isin("this_annotator", "annotator_observation") & ~F.coalesce(F.array_contains("own", c("ref_id")), F.lit(False)))
    if known_refs is not None:
        cites = cites.join(broadcast_if_small(known_refs.select("ref_id").distinct()), "ref_id", "left_anti")
    out = out.unionByName(cites.select(c("annotation_id").alias("id"), F.lit("N10").alias("rule"), F.lit("cites what is not there").alias("what")).distinct())
    if verified_refs is not None:
        said = a.select("annotation_id", F.explode("references").alias("r")).where(c("r.verification_status") == VERIFIED).select("annotation_id", c("r.ref_id").alias("ref_id"))
        unbacked = said.join(broadcast_if_small(verified_refs.select("ref_id").distinct()), "ref_id", "left_anti")
        out = out.unionByName(unbacked.select(c("annotation_id").alias("id"), F.lit("N14").alias("rule"), F.lit("verified without a record").alias("what")).distinct())
    return out


def adjudication_problems(a: DataFrame) -> DataFrame:
    """N18 across rows: what an adjudication resolves is unknown, of another artifact, or a prediction."""
    asked = a.where(c("adjudication").isNotNull()).select("annotation_id", c("artifact_id").alias("__own"), F.explode("adjudication.resolves").alias("__r"))
    target = a.select(c("annotation_id").alias("__r"), c("artifact_id").alias("__other"), c("provenance_type").alias("__kind"))
    j = asked.join(target, "__r", "left")
    return problems(j, "annotation_id", [("N18", "resolves unknown", c("__other").isNull()), ("N18", "resolves another artifact's", c("__other") != c("__own")), ("N18", "resolves a prediction", c("__kind") == "ai_prediction")])


# -- knowledge, verification, prechecks --------------------------------------------------------------------------------------------


def knowledge_problems(references: DataFrame, entries: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """K1 to K4, K8. references: id, citation, verification_status, resolution, candidate_works; entries: id, assertions (array of struct(reference_ids, verification_status))."""
    held = references.select(c("id").alias("ref_id"), c("resolution").alias("__res"))
    unresolved = c("resolution") == "unresolved"
    out = problems(references, "id", [
        ("K2", "no citation", ~real(c("citation"))), ("K2", "status", ~F.coalesce(c("verification_status").isin(*statuses), F.lit(False))),
        ("K8", "a placeholder is unverified", unresolved & ~c("verification_status").eqNullSafe(F.lit("unverified"))), ("K8", "a placeholder lists candidates", unresolved & c("candidate_works").isNull()),
    ])
    out = out.unionByName(repeated(references, "id", "K1")).unionByName(repeated(entries.select("id").unionByName(references.select("id").distinct()), "id", "K1"))
    one = entries.select("id", F.explode("assertions").alias("a"))
    out = out.unionByName(problems(one, "id", [("K3", "assertion without references", F.coalesce(F.size("a.reference_ids"), F.lit(0)) <= 0), ("K4", "status", ~F.coalesce(c("a.verification_status").isin(*statuses), F.lit(False)))]))
    cited = one.select("id", "a", F.explode("a.reference_ids").alias("ref_id")).join(held.dropDuplicates(["ref_id"]).withColumn("__there", F.lit(True)), "ref_id", "left")
    return out.unionByName(problems(cited, "id", [("K3", "unknown reference", c("__there").isNull()), ("K8", "verified against a placeholder", (c("__res") == "unresolved") & (c("a.verification_status") == VERIFIED))])).distinct()


def knowledge_claims(entries: DataFrame, positions: DataFrame) -> DataFrame:
    """claim_id, ref_ids, statement, recorded_in: all that cites a reference, from entries themselves (id, kind, reference_ids, printed), their assertions (array of struct(reference_ids, statement)) and configured positions (id, reference, label)."""
    own = entries.where(c("reference_ids").isNotNull()).select(c("id").alias("claim_id"), c("reference_ids").alias("ref_ids"), F.coalesce(F.nullif("printed", F.lit("")), "id").alias("statement"), F.concat(F.lit("knowledge/"), "kind").alias("recorded_in"))
    each = entries.select("id", "kind", F.posexplode("assertions").alias("i", "a"))
    said = each.select(F.concat("id", F.lit(".assertions["), c("i").cast("string"), F.lit("]")).alias("claim_id"), F.coalesce("a.reference_ids", F.array().cast("array<string>")).alias("ref_ids"), F.coalesce("a.statement", F.lit("")).alias("statement"), F.concat(F.lit("knowledge/"), "kind").alias("recorded_in"))
    config = positions.select(F.concat(F.lit("config:position_"), "id").alias("claim_id"), F.array("reference").alias("ref_ids"), c("label").alias("statement"), F.lit("config").alias("recorded_in"))
    return own.unionByName(said).unionByName(config)


def source_problems(entries: DataFrame, positions: DataFrame, references: DataFrame) -> DataFrame:
    """K5: verified without who and when (entries: id, verification_status, verified_by, verified_on). K7: a configured position (id, reference) that cites a reference that is not held (references: id)."""
    out = problems(entries, "id", [("K5", "verified_by and verified_on", (c("verification_status") == VERIFIED) & (~real(c("verified_by")) | ~real(c("verified_on").cast("string"))))])
    held = references.select(c("id").alias("reference")).distinct().withColumn("__there", F.lit(True))
    return out.unionByName(problems(positions.join(held, "reference", "left"), "id", [("K7", "unknown reference", c("__there").isNull())]))


def verification_problems(v: DataFrame, references: DataFrame, claims: DataFrame, today: Column) -> DataFrame:
    """V2 to V9 and K6. v: verification_id, ref_id, claim_id, claim, status, verifier, verifier_role, verification_date, locator, source_location, source_access, notes, supersedes."""
    refs = references.select(c("id").alias("ref_id"), c("resolution").alias("__res"), F.lit(True).alias("__there")).dropDuplicates(["ref_id"])
    known = claims.select("claim_id").distinct().withColumn("__claim", F.lit(True))
    j = v.join(refs, "ref_id", "left").join(known, "claim_id", "left")
    s, checked = c("status"), c("verification_date") != NA
    away = c("source_access") == "not_accessed"
    out = problems(j, "verification_id", [
        ("V2", "unknown reference", c("__there").isNull()), ("V9", "an unresolved placeholder", (c("__res") == "unresolved") & s.isin(VERIFIED, "discrepancy_found")),
        ("V3", "in the future", checked & (c("verification_date").try_cast("date") > today)), ("V3", "verifier and role", (s == VERIFIED) & (~real(c("verifier")) | ~stated(c("verifier_role")))), ("V3", "date", (s == VERIFIED) & ~checked),
        ("V3", "locator", (s == VERIFIED) & ~real(c("locator"))), ("V3", "source_location", (s == VERIFIED) & ~real(c("source_location"))), ("V3", "not accessed", (s == VERIFIED) & away),
        ("V4", "who, when and how", (s == "discrepancy_found") & (~real(c("verifier")) | ~checked | away)), ("V4", "notes", (s == "discrepancy_found") & ~real(c("notes"))),
        ("V5", "access", (s == "source_unavailable") & ~away), ("V5", "who, when and why", (s == "source_unavailable") & (~real(c("verifier")) | ~checked | ~real(c("notes")))),
        ("V6", "a date", (s == "unverified") & checked), ("V7", "unknown claim", (c("claim_id") != NA) & c("__claim").isNull()),
    ])
    key = F.struct("ref_id", F.when(c("claim_id") != NA, c("claim_id")).otherwise(F.lower(S.collapse_space(c("claim")))).alias("k"))
    late = v.where(c("supersedes").isNotNull()).select("verification_id", "supersedes", key.alias("__k"))
    prev = v.select(c("verification_id").alias("supersedes"), key.alias("__p"))
    met = late.join(prev, "supersedes", "left")
    out = out.unionByName(problems(met, "verification_id", [("V8", "supersedes unknown", c("__p").isNull()), ("V8", "supersedes another claim's", c("__p") != c("__k"))]))
    twice = late.groupBy("supersedes").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(c("supersedes").alias("id"), F.lit("V8").alias("rule"), F.lit("superseded twice").alias("what"))
    now = v.join(late.select(c("supersedes").alias("verification_id")).distinct(), "verification_id", "left_anti").where(s == VERIFIED).select(c("ref_id").alias("id")).distinct()
    k6 = references.where(c("verification_status") == VERIFIED).select("id").join(now, "id", "left_anti").select("id", F.lit("K6").alias("rule"), F.lit("verified without a record").alias("what"))
    return out.unionByName(repeated(v, "verification_id", "V8")).unionByName(twice).unionByName(k6)


def precheck_problems(checks: DataFrame, sources: DataFrame, references: DataFrame, claims: DataFrame, today: Column, readable: Sequence[str], found: Sequence[str]) -> DataFrame:
    """PC2 to PC8 of claim checks (precheck_id, ref_id, claim_id, source_id, finding, locator_found, excerpt, differences, check_date) and their sources (source_id, ref_id, access, accessed); claims: claim_id, ref_ids."""
    refs = references.select(c("id").alias("ref_id"), c("resolution").alias("__res"), F.lit(True).alias("__there")).dropDuplicates(["ref_id"])
    held = sources.select("source_id", c("ref_id").alias("__sref"), "access").dropDuplicates(["source_id"])
    j = checks.join(refs, "ref_id", "left").join(held, "source_id", "left").join(claims.select("claim_id", "ref_ids").dropDuplicates(["claim_id"]), "claim_id", "left")
    hit = c("finding").isin(*found)
    out = problems(j, "precheck_id", [
        ("PC2", "unknown reference", c("__there").isNull()), ("PC7", "an unresolved placeholder", (c("__res") == "unresolved") & hit), ("PC3", "unknown claim", c("ref_ids").isNull()), ("PC3", "claim of another reference", ~F.array_contains("ref_ids", c("ref_id"))),
        ("PC4", "unknown source", c("__sref").isNull()), ("PC4", "source of another reference", c("__sref") != c("ref_id")), ("PC6", "source without the text", (c("finding") != "source_not_accessible") & ~c("access").isin(*readable)),
        ("PC5", "locator and excerpt", hit & (~real(c("locator_found")) | ~real(c("excerpt")))), ("PC5", "differences", (c("finding") == "found_with_differences") & ~real(c("differences"))), ("PC8", "in the future", c("check_date").try_cast("date") > today),
    ])
    s = sources.join(refs, "ref_id", "left")
    out = out.unionByName(problems(s, "source_id", [("PC2", "unknown reference", c("__there").isNull()), ("PC8", "in the future", c("accessed").try_cast("date") > today)]))
    return out.unionByName(repeated(checks, "precheck_id", "PC8")).unionByName(repeated(sources, "source_id", "PC8"))


# -- joins and helpers around records -------------------------------------------------------------------------------------------------


def identify(photos: DataFrame, records: DataFrame) -> DataFrame:
    """sha256, artifact_id, status: known, ambiguous (several artifacts) or unknown, for each photo's digest."""
    g = records.where(c("sha256").isNotNull()).groupBy("sha256").agg(F.count_distinct("artifact_id").alias("n"), F.min("artifact_id").alias("a"))
    return photos.select("sha256").join(g, "sha256", "left").select("sha256", F.when(c("n") == 1, c("a")).alias("artifact_id"), F.when(c("n").isNull(), "unknown").when(c("n") > 1, "ambiguous").otherwise("known").alias("status"))


def provenance_gaps(records: DataFrame, provenance: DataFrame) -> DataFrame:
    """image_id, problem: records without provenance, or whose digest is another."""
    p = provenance.select("image_id", c("sha256").alias("__p"), F.lit(True).alias("__there"))
    what = F.when(c("__there").isNull(), "missing").when(~c("sha256").eqNullSafe(c("__p")), "mismatch")
    return records.select("image_id", "sha256").join(p, "image_id", "left").select("image_id", what.alias("problem")).where("problem IS NOT NULL")


def not_yet_known(incoming: DataFrame, known: DataFrame, key: str = "sha256") -> DataFrame:
    """Incoming rows whose key no known row has, and of those of one key the first by their id."""
    fresh = incoming.join(known.select(key).distinct(), key, "left_anti")
    rest = [x for x in fresh.columns if x != key]
    return fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")


def script_of(text: Column) -> Column:
    """A reading's script by its characters' blocks: brahmi_unicode, tamil_unicode, romanized, mixed or not_available."""
    bare = F.regexp_replace(text, r"[\x{11000}-\x{1107F}\x{0B80}-\x{0BFF}]", "")
    kinds = S.present((text.rlike(r"[\x{11000}-\x{1107F}]"), "brahmi_unicode"), (text.rlike(r"[\x{0B80}-\x{0BFF}]"), "tamil_unicode"), (bare.rlike(r"\p{L}"), "romanized"))
    return F.when(F.size(kinds) > 1, "mixed").otherwise(F.coalesce(F.try_element_at(kinds, F.lit(1)), F.lit("not_available")))


def crop_boxes(rows: DataFrame, regions: DataFrame, image: str, row: str) -> DataFrame:
    """image, row, x0, y0, x1, y1: each row's box, widened to the largest region that holds its centre. Boxes have corners x0, y0, x1, y1."""
    g = regions.select(image, *[c(k).alias(f"g{k}") for k in ("x0", "y0", "x1", "y1")])
    cx, cy = (c("x0") + c("x1")) / 2, (c("y0") + c("y1")) / 2
    held = rows.join(g, image).where(cx.between(c("gx0"), c("gx1")) & cy.between(c("gy0"), c("gy1")))
    area = (c("gx1") - c("gx0")) * (c("gy1") - c("gy0"))
    best = held.groupBy(image, row).agg(F.max(F.struct(area.alias("a"), "gx0", "gy0", "gx1", "gy1")).alias("b")).select(image, row, "b.*")
    j = rows.join(best, [image, row], "left")
    return j.select(image, row, F.least("x0", "gx0").alias("x0"), F.least("y0", "gy0").alias("y0"), F.greatest("x1", "gx1").alias("x1"), F.greatest("y1", "gy1").alias("y1"))


def words_by_gap(glyphs: DataFrame, row: str) -> DataFrame:
    """glyphs (cx, w, h) with ``word``: along a row, a gap over 0.4 median heights and 1.8 median gaps starts a new one. A row holds few glyphs."""
    order, whole = Window.partitionBy(row).orderBy("cx"), Window.partitionBy(row)
    g = glyphs.withColumn("__gap", c("cx") - F.lag("cx").over(order) - (c("w") + F.lag("w").over(order)) / 2)
    g = g.withColumn("__mh", F.median("h").over(whole)).withColumn("__mg", F.coalesce(F.median("__gap").over(whole), F.lit(0.0)))
    limit = F.greatest(0.4 * c("__mh"), 1.8 * F.greatest(c("__mg"), 0.05 * c("__mh")))
    return g.withColumn("word", F.sum(F.coalesce((c("__gap") > limit).cast("int"), F.lit(0))).over(order)).drop("__gap", "__mh", "__mg")


def annotation_queue(items: DataFrame, resolutions: DataFrame, pilot: DataFrame, steps: dict[str, str]) -> DataFrame:
    """item, in_pilot, status, next_step; order by in_pilot descending, then item."""
    p = pilot.select("item").distinct().withColumn("in_pilot", F.lit(True))
    j = items.select("item").distinct().join(p, "item", "left").join(resolutions.select("item", "status"), "item", "left")
    status = F.coalesce("status", F.lit("unannotated"))
    table = F.create_map(*[F.lit(x) for kv in steps.items() for x in kv])
    return j.select("item", F.coalesce("in_pilot", F.lit(False)).alias("in_pilot"), status.alias("status"), F.try_element_at(table, status).alias("next_step"))


def worksheet_conflicts(cells: DataFrame, item: str, fields: Sequence[str]) -> DataFrame:
    """item, field, n_values: rows of one item that fill in a field differently; blanks do not count. Headers are matched before ' ('."""
    named = cells.select(*[c(f"`{x}`").alias(x.split(" (")[0].strip()) for x in cells.columns])
    long = named.select(item, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(F.trim(c(f)), F.lit("")).alias("v")) for f in fields])).alias("x")).select(item, "x.*")
    return long.groupBy(item, "field").agg(F.count_distinct("v").alias("n_values")).where("n_values > 1")


def evidence_votes(votes: DataFrame, item: str, category: str, weight: str) -> DataFrame:
    """item, category of the largest weight; ties give several rows."""
    g = votes.groupBy(item, category).agg(F.sum(weight).alias("w"))
    return g.withColumn("r", F.rank().over(Window.partitionBy(item).orderBy(F.desc("w")))).where("r = 1").drop("r")


def common_categories(sets: DataFrame, item: str, allowed: str) -> DataFrame:
    """item, categories that all of an item's sources allow, sorted."""
    x = sets.select(item, F.explode(F.array_distinct(allowed)).alias("k"))
    n = sets.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    g = x.groupBy(item, "k").agg(F.count(F.lit(1)).alias("m")).join(n, item).where("m = n")
    return n.select(item).join(g.groupBy(item).agg(F.array_sort(F.collect_list("k")).alias("categories")), item, "left").select(item, F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))
