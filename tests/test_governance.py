"""The rule families of annotations, knowledge and verification; the helpers around records."""

from pyspark.sql import functions as F

from curata.operators import governance as G

ANNOTATION = """
annotation_id string, artifact_id string, image_ids array<string>, provenance_type string, role string, qualification string, review_state string,
inscription struct<inscription_present:string,inscription_type:string,script_type:string,script_confidence:string,reading:string,reading_source:string,reading_confidence:string,reading_completeness:string,
  regions:array<struct<image_id:string,x:double,y:double,width:double,height:double,label:string,sign_index:int>>>,
interpretation struct<interpretation_type:string,translation:string,translation_source:string,translation_confidence:string>,
dating struct<estimated_start_year:int,estimated_end_year:int,dating_confidence:string,dating_basis:array<string>,dating_evidence:array<struct<evidence_id:string,evidence_type:string,supports_start_year:int,supports_end_year:int,association:string,source_reference:string>>>,
references array<struct<ref_id:string,verification_status:string>>, image_usability array<struct<image_id:string>>, adjudication struct<resolves:array<string>,outcome:string>, ai_marked boolean
"""


def annotation(**change):
    a = {
        "annotation_id": "a1", "artifact_id": "x", "image_ids": ["i1"], "provenance_type": "expert_annotation", "role": "expert", "qualification": "PhD", "review_state": "expert_reviewed",
        "inscription": {"inscription_present": "yes", "inscription_type": "owner", "script_type": "b", "script_confidence": "high", "reading": "abc", "reading_source": "this_annotator", "reading_confidence": "low", "reading_completeness": "complete", "regions": []},
        "interpretation": {"interpretation_type": "word", "translation": "unknown", "translation_source": "unknown", "translation_confidence": "unknown"},
        "dating": {"estimated_start_year": None, "estimated_end_year": None, "dating_confidence": "unknown", "dating_basis": ["unknown"], "dating_evidence": []}, "references": [], "image_usability": [], "adjudication": None, "ai_marked": False,
    }
    for k, v in change.items():
        a[k] = {**a[k], **v} if isinstance(a[k], dict) and isinstance(v, dict) else v
    return a


def box(image="i1", x=0.1, w=0.2, label="mark", index=None):
    return {"image_id": image, "x": x, "y": 0.0, "width": w, "height": 0.5, "label": label, "sign_index": index}


CASES = [
    ({}, set()),
    ({"role": "ai_model"}, {"N4"}),
    ({"provenance_type": "project_annotation", "role": "project_annotator"}, {"N4"}),
    ({"provenance_type": "source_information", "role": "project_annotator", "review_state": "unreviewed"}, {"N5"}),
    ({"inscription": {"script_type": "none"}}, {"N6"}),
    ({"inscription": {"reading_source": "unknown"}}, {"N7"}),
    ({"inscription": {"reading": "unknown", "reading_completeness": "unknown"}}, {"N7"}),
    ({"interpretation": {"interpretation_type": "personal_name"}}, {"N8"}),
    ({"dating": {"estimated_start_year": 5, "dating_confidence": "low"}}, {"N9"}),
    ({"inscription": {"reading_source": "R9"}}, {"N10"}),
    ({"inscription": {"reading_source": "R1"}}, set()),
    ({"image_usability": [{"image_id": "i2"}]}, {"N13"}),
    ({"references": [{"ref_id": "R1", "verification_status": "verified_against_source"}]}, {"N14"}),
    ({"references": [{"ref_id": "R2", "verification_status": "verified_against_source"}]}, set()),
    ({"ai_marked": True}, {"N15"}),
    ({"adjudication": {"resolves": ["a1"], "outcome": "agreed"}}, {"N18"}),
    ({"inscription": {"regions": [box(x=0.9)]}}, {"N3"}),
    ({"inscription": {"regions": [box(image="i2")]}}, {"N3"}),
    ({"inscription": {"regions": [box(label="character", index=1), box(label="character", index=1)]}}, {"N19"}),
    ({"inscription": {"regions": [box(index=1)]}}, {"N19"}),
    ({"inscription": {"reading_completeness": "illegible"}}, {"N20"}),
    ({"artifact_id": "y"}, {"N2"}),
]


def test_annotation_rules(spark):
    rows = [annotation(**{**change, "annotation_id": f"a{n}"} if "adjudication" not in change else {**change, "annotation_id": "a1"}) for n, (change, _) in enumerate(CASES, 100)]
    refs = spark.createDataFrame([("R1",), ("R2",)], "ref_id string")
    images = spark.createDataFrame([("x", "i1")], "artifact_id string, image_id string")
    found = G.annotation_problems(spark.createDataFrame(rows, ANNOTATION), refs, images, refs.where("ref_id = 'R2'")).collect()
    by = {}
    for r in found:
        by.setdefault(r.id, set()).add(r.rule)
    for row, (change, want) in zip(rows, CASES, strict=True):
        assert by.get(row["annotation_id"], set()) == want, change


def test_adjudication_across_rows(spark):
    rows = [annotation(annotation_id="p", provenance_type="ai_prediction"), annotation(annotation_id="o", artifact_id="y"), annotation(annotation_id="j", adjudication={"resolves": ["p", "o", "q"], "outcome": "agreed"})]
    assert sorted(r.what for r in G.adjudication_problems(spark.createDataFrame(rows, ANNOTATION)).collect()) == ["resolves a prediction", "resolves another artifact's", "resolves unknown"]


REFS = "id string, citation string, verification_status string, resolution string, candidate_works array<string>"


def references(spark):
    return spark.createDataFrame([("R1", "book", "unverified", None, None), ("R2", "tome", "verified_against_source", None, None), ("R3", "?", "located", "unresolved", None), ("R4", "", "odd", None, None)], REFS)


def test_knowledge_rules(spark):
    entries = spark.createDataFrame(
        [("e1", [(["R1"], "unverified")]), ("e2", [([], "unverified"), (["R9"], "x")]), ("e3", [(["R3"], "verified_against_source")]), ("R1", [])], "id string, assertions array<struct<reference_ids:array<string>,verification_status:string>>"
    )
    out = {(r.id, r.rule) for r in G.knowledge_problems(references(spark), entries, ["unverified", "located", G.VERIFIED]).collect()}
    assert out == {("R3", "K8"), ("R4", "K2"), ("R1", "K1"), ("e2", "K3"), ("e2", "K4"), ("e3", "K8")}


V = "verification_id string, ref_id string, claim_id string, claim string, status string, verifier string, verifier_role string, verification_date string, locator string, source_location string, source_access string, notes string, supersedes string"


def test_verification_rules(spark):
    ok = ("R1", "c1", "text", G.VERIFIED, "ann", "librarian", "2024-01-02", "p. 3", "library", "print", "n", None)
    rows = [("v1", *ok), ("v2", "R9", *ok[1:]), ("v3", "R3", *ok[1:]), ("v4", *ok[:6], "2999-01-01", *ok[7:]), ("v5", *ok[:3], "discrepancy_found", *ok[4:10], "", None), ("v6", *ok[:3], "unverified", *ok[4:]), ("v7", "R1", "c9", *ok[2:]), ("v8", *ok[:11], "v1"), ("v9", *ok[:11], "v1"), ("v10", *ok[:11], "vv")]
    claims = spark.createDataFrame([("c1",)], "claim_id string")
    out = {(r.id, r.rule) for r in G.verification_problems(spark.createDataFrame(rows, V), references(spark), claims, F.lit("2025-01-01").cast("date")).collect()}
    assert out == {("v2", "V2"), ("v3", "V9"), ("v4", "V3"), ("v5", "V4"), ("v6", "V6"), ("v7", "V7"), ("v1", "V8"), ("v10", "V8"), ("R2", "K6")}


def test_precheck_rules(spark):
    checks = spark.createDataFrame(
        [("p1", "R1", "c1", "s1", "found", "p. 1", "words", None, "2024-01-01"), ("p2", "R9", "c1", "s1", "found", "p", "w", None, "2024-01-01"), ("p3", "R1", "c9", "s9", "found", "", "w", None, "2999-01-01"), ("p4", "R1", "c1", "s2", "found_with_differences", "p", "w", "", "2024-01-01")],
        "precheck_id string, ref_id string, claim_id string, source_id string, finding string, locator_found string, excerpt string, differences string, check_date string",
    )
    sources = spark.createDataFrame([("s1", "R1", "full_text", "2024-01-01"), ("s2", "R1", "catalogue", "2024-01-01")], "source_id string, ref_id string, access string, accessed string")
    claims = spark.createDataFrame([("c1", ["R1"])], "claim_id string, ref_ids array<string>")
    out = {(r.id, r.rule) for r in G.precheck_problems(checks, sources, references(spark), claims, F.lit("2025-01-01").cast("date"), ["full_text"], ["found", "found_with_differences"]).collect()}
    assert out == {("p2", "PC2"), ("p2", "PC3"), ("p2", "PC4"), ("p3", "PC3"), ("p3", "PC4"), ("p3", "PC5"), ("p3", "PC8"), ("p4", "PC6"), ("p4", "PC5")}


def test_helpers(spark):
    r = spark.createDataFrame([("h1", "a", "i1"), ("h1", "a", "i2"), ("h2", "a", "i3"), ("h2", "b", "i4")], "sha256 string, artifact_id string, image_id string")
    photos = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "sha256 string")
    assert {tuple(x) for x in G.identify(photos, r).collect()} == {("h1", "a", "known"), ("h2", None, "ambiguous"), ("h3", None, "unknown")}
    p = spark.createDataFrame([("i1", "h1"), ("i2", "zz"), ("i3", "h2")], "image_id string, sha256 string")
    assert {tuple(x) for x in G.provenance_gaps(r, p).collect()} == {("i2", "mismatch"), ("i4", "missing")}
    new = spark.createDataFrame([("h1", 1), ("h8", 3), ("h8", 2)], "sha256 string, n int")
    assert [tuple(x) for x in G.not_yet_known(new, r).collect()] == [("h8", 2)]
    texts = spark.createDataFrame([("𑀅𑀆",), ("தமிழ்",), ("amma 3",), ("அ a",), ("12 !",)], "t string")
    assert [x[0] for x in texts.select(G.script_of(F.col("t"))).collect()] == ["brahmi_unicode", "tamil_unicode", "romanized", "mixed", "not_available"]
    glyphs = spark.createDataFrame([("r", float(x), 8.0, 10.0) for x in (0, 10, 20, 60, 70)], "row string, cx double, w double, h double")
    assert [x.word for x in G.words_by_gap(glyphs, "row").orderBy("cx").collect()] == [0, 0, 0, 1, 1]
    rows = spark.createDataFrame([("i", 1, 10, 10, 20, 12), ("i", 2, 50, 50, 60, 60)], "image string, row int, x0 int, y0 int, x1 int, y1 int")
    regions = spark.createDataFrame([("i", 5, 5, 30, 30), ("i", 12, 9, 18, 13)], "image string, x0 int, y0 int, x1 int, y1 int")
    assert sorted(tuple(x) for x in G.crop_boxes(rows, regions, "image", "row").collect()) == [("i", 1, 5, 5, 30, 30), ("i", 2, 50, 50, 60, 60)]
    cells = spark.createDataFrame([("a", "x", ""), ("a", "y", "1"), ("b", "x", "1")], "`item (id)` string, `label (one of)` string, `n` string")
    assert [tuple(x) for x in G.worksheet_conflicts(cells, "item", ["label", "n"]).collect()] == [("a", "label", 2)]
    sets = spark.createDataFrame([("a", ["x", "y"]), ("a", ["y", "z"]), ("b", ["x"]), ("b", ["z"])], "item string, k array<string>")
    assert {x.item: x.categories for x in G.common_categories(sets, "item", "k").collect()} == {"a": ["y"], "b": []}
    votes = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("a", "x", 1.0)], "item string, k string, w double")
    assert {x.k for x in G.evidence_votes(votes, "item", "k", "w").collect()} == {"x", "y"}
    q = G.annotation_queue(spark.createDataFrame([("a",), ("b",)], "item string"), spark.createDataFrame([("a", "disputed")], "item string, status string"), spark.createDataFrame([("b",)], "item string"), {"disputed": "adjudicate", "unannotated": "annotate"})
    assert sorted(tuple(x) for x in q.collect()) == [("a", False, "disputed", "adjudicate"), ("b", True, "unannotated", "annotate")]


def test_synthetic_reasons(spark):
    df = spark.createDataFrame([("SYN-1", "a/b.jpg", "x"), ("art", "data/Synthetic/q.jpg", "x"), ("art", "ok.jpg", "made")], "artifact_id string, image_path string, script_type string")
    out = [r[0] for r in df.select(G.synthetic_reasons("SYN-", "generator", "generated", ["made"], "MARK", df.columns)).collect()]
    assert out == [["artifact_id"], ["image_path"], ["script_type"]]
