"""Evidence: interval folds, period overlap, claim and reference status, policy and licence decisions, gates, the fictional grammar, boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import scalars as S
from curata.functions.matching import one_to_one
from curata.plans.storage import broadcast_if_small, ship

# Allowed licences, their order of refusal, approved image types, own-work marks, blocked hosts are parameters below.
ALLOWED = ("CC0-1.0", "CC-BY-2.0", "CC-BY-2.5", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-2.0", "CC-BY-SA-2.5", "CC-BY-SA-3.0", "CC-BY-SA-4.0")
CONFIDENCE = ["unknown", "very_low", "low", "moderate", "high"]


def period_overlap(df: DataFrame, start: str, end: str, periods: DataFrame) -> DataFrame:
    """Rows with the periods they lie within or overlap. periods (period, p_start, p_end) is a table of names: counted, then broadcast."""
    meets = (F.col(start) <= F.col("p_end")) & (F.col(end) >= F.col("p_start"))
    within = (F.col(start) >= F.col("p_start")) & (F.col(end) <= F.col("p_end"))
    return df.join(broadcast_if_small(periods, 10_000), meets).withColumn("relation", F.when(within, "within").otherwise("overlaps"))


def reference_status(references: DataFrame, records: DataFrame) -> DataFrame:
    """ref_id, effective: any discrepancy, else any verification, else the reference's own status (a claim of its own to be verified does not count)."""
    g = records.groupBy("ref_id").agg(F.bool_or(F.col("status") == "discrepancy_found").alias("d"), F.bool_or(F.col("status") == "verified_against_source").alias("v"))
    own = F.when(F.col("kb_status") == "verified_against_source", "unverified").otherwise(F.coalesce("kb_status", F.lit("unverified")))
    status = F.when(F.coalesce("d", F.lit(False)), "discrepancy_found").when(F.coalesce("v", F.lit(False)), "verified_against_source").otherwise(own)
    return references.join(g, "ref_id", "left").select("ref_id", status.alias("effective"))


def claim_report(claims: DataFrame, records: DataFrame, order: str) -> DataFrame:
    """claim_id, ref_id, status, one row for each citation: the latest record (by ``order``) under the claim's id, else that under its text, else unverified. claims has ref_ids (an array) and statement."""
    text = lambda c: F.lower(S.collapse_space(c))
    edges = claims.select("claim_id", text(F.col("statement")).alias("key_text"), F.explode(F.array_distinct("ref_ids")).alias("ref_id")).distinct()
    by_id = records.where("claim_id IS NOT NULL").groupBy("ref_id", "claim_id").agg(F.max_by("status", order).alias("s1"))
    by_text = records.where("claim_id IS NULL").groupBy("ref_id", text(F.col("claim")).alias("key_text")).agg(F.max_by("status", order).alias("s2"))
    return edges.join(by_id, ["ref_id", "claim_id"], "left").join(by_text, ["ref_id", "key_text"], "left").select("claim_id", "ref_id", F.coalesce("s1", "s2", F.lit("unverified")).alias("status"))


# Spellings that are recognised, and the ids they stand for.
ZERO_IDS, DOMAIN_IDS, GODL = ("CC0", "CC0 1.0", "CC ZERO"), ("PD", "PDM", "PUBLIC DOMAIN"), "GODL"
PARTS = ("BY", "SA", "NC", "ND")


def license_id(verbatim: Column) -> Column:
    """Normalised licence id, public_domain, GODL-India or unknown. The words are read from the left: CC, then parts of which the first is BY, then a version, then only words."""
    plain = F.upper(F.coalesce(verbatim, F.lit("")))
    words = F.filter(F.split(F.regexp_replace(plain, "(BY|SA|NC|ND)(?=[0-9])", "$1 "), r"[\s_-]+"), lambda w: w != "")
    joined = F.array_join(words, " ")
    n = F.size(F.filter(words, lambda w: w.isin(*PARTS)))
    version = F.try_element_at(words, n + 2)
    is_cc = (F.slice(words, 1, 2) == F.array(F.lit("CC"), F.lit("BY"))) & F.forall(F.slice(words, F.lit(2), n), lambda w: w.isin(*PARTS)) & version.rlike(r"^[0-9]\.[0-9]$") & F.forall(F.slice(words, n + 3, F.size(words)), lambda w: w.rlike("^[A-Z]+$"))
    of_parts = F.array_join(F.concat(F.array(F.lit("CC")), F.slice(words, F.lit(2), n), F.array(version)), "-")
    named = [(joined.isin(*ZERO_IDS), F.lit("CC0-1.0")), (is_cc, of_parts), (F.regexp_replace(plain, r"\s+", " ").contains("PUBLIC DOMAIN") | joined.isin(*DOMAIN_IDS), F.lit("public_domain")), (plain.contains(GODL), F.lit("GODL-India"))]
    return F.coalesce(*[F.when(found, name) for found, name in named], F.lit("unknown"))


def license_decision(verbatim: Column) -> Column:
    """struct(id, accepted, why): refused in the order unknown, no derivatives, non-commercial, public domain, GODL, not on the list."""
    i = license_id(verbatim)
    why = (
        F.when(i.isin(*ALLOWED), "allowed").when(i == "unknown", "unknown").when(i.contains("-ND-") | i.endswith("-ND"), "no_derivatives").when(i.contains("-NC-"), "non_commercial")
        .when(i == "public_domain", "public_domain").when(i == "GODL-India", "godl").otherwise("not_listed")
    )
    return F.struct(i.alias("id"), i.isin(*ALLOWED).alias("accepted"), why.alias("why"))


def url_problems(url: Column, blocked: Sequence[str] = (), approved: Sequence[str] = ()) -> Column:
    """A2: missing, not https, a blocked host or one below it, not an approved host."""
    host = S.url_host(url)
    is_blocked = F.lit(False)
    for b in blocked:
        is_blocked = is_blocked | (host == b) | host.endswith(f".{b}")
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "missing").when(~url.startswith("https://"), "not_https").when(is_blocked, "blocked")
        .when(~host.isin(*approved) if approved else F.lit(False), "not_approved")
    )


def policy(df: DataFrame, sources: Sequence[str], types: Sequence[str], own_work: Sequence[str], flags: Sequence[str], max_bytes: int, blocked: Sequence[str], excluded: DataFrame | None = None) -> DataFrame:
    """df with ``reasons``, all rules A1 to A9 that a candidate fails, and ``accepted``. Columns: source, source_url, image_url, license, credit, restrictions, categories, title, record_id, artist, checksum, mime, size_bytes."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    marked = F.lit(False)
    for m in own_work:
        marked = marked | F.lower(text("credit")).contains(m)
    flagged = F.coalesce(F.exists("categories", lambda c: F.lower(c).rlike("|".join(flags))), F.lit(False)) if flags else F.lit(False)
    checks = [
        (~F.coalesce(F.col("source").isin(*sources), F.lit(False)), "A1"), (url_problems(F.col("source_url"), blocked).isNotNull(), "A2:source_url"), (url_problems(F.col("image_url"), blocked).isNotNull(), "A2:image_url"),
        (~license_decision(F.col("license"))["accepted"], "A3"), (~marked, "A4"), (F.trim(text("restrictions")) != "", "A5:restrictions"), (flagged, "A5:flagged"),
        *[(F.trim(text(c)) == "", f"A6:{c}") for c in ("title", "record_id", "artist", "checksum")], (~F.coalesce(F.col("mime").isin(*types), F.lit(False)), "A7"),
        (~F.coalesce(F.col("size_bytes").between(1, max_bytes), F.lit(False)), "A8"),
    ]
    if excluded is not None:
        df = df.join(broadcast_if_small(excluded.select("title", F.lit(True).alias("__out")).distinct()), "title", "left")
        checks.append((F.coalesce("__out", F.lit(False)), "A9"))
    out = df.withColumn("reasons", S.present(*checks)).withColumn("accepted", F.size("reasons") == 0)
    return out.drop("__out")


def gates(row: DataFrame, checks: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """gate_no, gate, result for a one-row table: (name, may be evaluated, passes). What may not be evaluated is NOT_EVALUATED, which counts as failed."""
    one = [F.struct(F.lit(i).alias("gate_no"), F.lit(n).alias("gate"), F.when(~F.coalesce(can, F.lit(False)), "NOT_EVALUATED").when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("result")) for i, (n, can, ok) in enumerate(checks, 1)]
    return row.select(F.explode(F.array(*one)).alias("g")).select("g.*")


def current_stage(stages: DataFrame, number: str = "gate_no", name: str = "gate", result: str = "result") -> DataFrame:
    """One row: the first stage that does not pass (or COMPLETE), and how many pass."""
    first = F.min(F.when(F.col(result) != "PASS", F.struct(number, name)))
    return stages.agg(F.coalesce(first[name], F.lit("COMPLETE")).alias("stage"), F.count_if(F.col(result) == "PASS").alias("n_passed"), F.count(F.lit(1)).alias("n_stages"))


# -- a grammar of codes: clauses of ([numeral] noun) ([numeral] noun) verb [negation] ---------------------

CLAUSE = "#?N#?NV-?"


def word_classes(codes: Column, classes: dict[str, str]) -> Column:
    """One character a code: # numeral, N noun, V verb, - negation, ? unknown."""
    table = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    return F.array_join(F.transform(codes, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("?"))), "")


def decode(codes: Column, classes: dict[str, str]) -> Column:
    """struct(status, n_clauses, n_translated): insufficient_evidence, unknown_glyph, translated, partial or invalid_sequence; the longest prefix of whole clauses counts."""
    s = word_classes(codes, classes)
    prefix = F.regexp_extract(s, f"^((?:{CLAUSE})+)", 1)
    n = F.when(s.contains("?"), 0).otherwise(F.length(prefix))
    status = F.when(F.coalesce(F.size(codes), F.lit(0)) <= 0, "insufficient_evidence").when(s.contains("?"), "unknown_glyph").when(n == 0, "invalid_sequence").when(n == F.length(s), "translated").otherwise("partial")
    clauses = F.when(n > 0, F.size(F.regexp_extract_all(prefix, F.lit("V"), 0))).otherwise(0)
    return F.struct(status.alias("status"), clauses.cast("int").alias("n_clauses"), n.cast("int").alias("n_translated"))


def transliterate(codes: Column, readings: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in readings.items() for x in kv])
    return F.array_join(F.transform(codes, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("[?]"))), " ")


# -- boxes ------------------------------------------------------------------------------------------------


def best_iou(a: DataFrame, b: DataFrame, image: str, a_id: str, box: str) -> DataFrame:
    """Each box of a with its best IoU over b's boxes of the same image; 0 without any."""
    other = b.select(image, F.col(box).alias("__b"))
    met = a.join(other, image, "left").withColumn("iou", F.when(F.col("__b").isNull(), 0.0).otherwise(S.iou(F.col(box), F.col("__b"))))
    return met.groupBy(image, a_id).agg(F.max("iou").alias("best_iou"))


def greedy_match(pred: DataFrame, truth: DataFrame, image: str, index: str, box: str, threshold: float = 0.5) -> DataFrame:
    """image, pred_index, truth_index, iou: one-to-one, by falling IoU, ties to the larger indices.

    Candidates at the threshold or above are found by a join in the JVM and sorted by image and order of choice; the choice itself, sequential by
    its nature, streams over them.
    """
    p = pred.select(image, F.col(index).alias("pred_index"), F.col(box).alias("pb"))
    t = truth.select(image, F.col(index).alias("truth_index"), F.col(box).alias("tb"))
    cand = p.join(t, image).select(image, "pred_index", "truth_index", S.iou(F.col("pb"), F.col("tb")).alias("iou")).where(F.col("iou") >= threshold)
    ship(cand.sparkSession)
    return cand.repartition(image).sortWithinPartitions(image, F.desc("iou"), F.desc("pred_index"), F.desc("truth_index")).mapInArrow(one_to_one(0, 1, 2), cand.schema)


def centre_match(pred: DataFrame, truth: DataFrame, row: str, index: str) -> DataFrame:
    """row, pred_index, truth_index: predictions in their order take the nearest free true centre within half its larger side. Columns: cx, cy; w, h in truth."""
    p = pred.select(row, F.col(index).alias("pred_index"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    t = truth.select(row, F.col(index).alias("truth_index"), "cx", "cy", "w", "h")
    d = F.hypot(F.col("px") - F.col("cx"), F.col("py") - F.col("cy"))
    cand = p.join(t, row).withColumn("d", d).where(F.col("d") <= 0.5 * F.greatest("w", "h")).select(row, "pred_index", "truth_index", "d")
    ship(cand.sparkSession)
    return cand.repartition(row).sortWithinPartitions(row, "pred_index", "d", "truth_index").mapInArrow(one_to_one(0, 1, 2), cand.schema).drop("d")


def detection_report(matches: DataFrame, pred: DataFrame, truth: DataFrame, image: str, zero_undefined: bool = False) -> DataFrame:
    """One row: true and false positives, false negatives, precision, recall, F1 (null, or 0 with zero_undefined, where undefined), mean IoU, images with missed boxes."""
    n = lambda df, name: df.groupBy(image).agg(F.count(F.lit(1)).alias(name))
    m = matches.groupBy(image).agg(F.count(F.lit(1)).alias("m"), F.sum("iou").alias("s"))
    j = n(truth, "t").join(n(pred, "p"), image, "full_outer").join(m, image, "left").fillna(0)
    r = j.agg(F.sum("m").alias("tp"), F.sum(F.col("p") - F.col("m")).alias("fp"), F.sum(F.col("t") - F.col("m")).alias("fn"), F.sum("s").alias("s"), F.count_if(F.col("m") < F.col("t")).alias("n_missed_images"))
    p, q = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    if zero_undefined:
        p, q = F.coalesce(p, F.lit(0.0)), F.coalesce(q, F.lit(0.0))
    f = F.when(p.isNull() | q.isNull(), None).otherwise(F.coalesce(F.try_divide(2 * p * q, p + q), F.lit(0.0)))
    return r.select("tp", "fp", "fn", p.alias("precision"), q.alias("recall"), f.alias("f1"), F.try_divide(F.col("s"), F.col("tp").cast("double")).alias("mean_iou"), "n_missed_images")
