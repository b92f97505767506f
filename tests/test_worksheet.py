"""Worksheets and checklists: cells, conflicts, revisions, and sheets that go in whole or not at all."""

import csv

import pytest
from pyspark.sql import functions as F

from curata.operators.publication import Refused
from curata.plans.versions import Published
from curata.sources import worksheet as W

HEAD = ["artifact_id", "image_id", "annotator_id (yours)", "script_type (one of: a, b)", "reading", "regions (x,y,w,h label)", "dating_evidence", "dating_object_or_context", "dating_range", "references", "alternative_readings", "review_state", "usable_for_annotation"]
KNOWN = [("r1", "verified_against_source"), ("r2", "unverified")]


def sheet(spark, tmp_path, *rows):
    path = tmp_path / "sheet.csv"
    with path.open("w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(HEAD)
        for r in rows:
            out.writerow([r.get(h.split(" (")[0], "") for h in HEAD])
    return W.read_sheet(spark, f"file://{path}")


def load(spark, tmp_path, *rows, current=(), **more):
    return W.import_worksheet(sheet(spark, tmp_path, *rows), spark.createDataFrame(KNOWN, "ref_id string, status string"), spark.createDataFrame(list(current), "artifact_id string, annotator_id string, annotation_id string"), **more)


def problems(done):
    return sorted((r.row, r.column, r.problem) for r in done.problems.collect())


def row(**more):
    return {"artifact_id": "A", "image_id": "i1", "annotator_id": "me"} | more


def test_a_filled_sheet(spark, tmp_path):
    done = load(
        spark, tmp_path,
        row(script_type="brahmi", reading='ka "ti"', regions="0,0,.5,0.5 character #2 'ka'; 0.1, 0.2 ,0.3,0.4 text", dating_evidence="palaeography; form; -200..100; r1 | stratigraphy; layer; -;", dating_object_or_context="Context only", dating_range="-200 to 100", references="r1 p. 5, fig. 2; r2; r1 again", usable_for_annotation="yes"),
        row(image_id="i2", script_type="brahmi", regions="on the rim", alternative_readings="ki (r2); ku", dating_range="insufficient evidence"),
        {}, {"artifact_id": "B", "image_id": "i3"},
    )
    assert problems(done) == [(2, "references", "unknown reference fig.")] and [r.row for r in done.skipped.orderBy("row").collect()] == [4, 5]
    (r,) = done.rows.collect()
    assert (r.artifact_id, r.annotator_id, r.image_ids, r.script_type, r.reading, r.start, r.end, r.supersedes) == ("A", "me", ["i1", "i2"], "brahmi", 'ka "ti"', -200, 100, None)
    assert [(x.image_id, x.x, x.height, x.label, x.sign_index, x.sign_reading) for x in r.regions] == [("i1", 0.0, 0.5, "character", 2, "ka"), ("i1", 0.1, 0.4, "text", None, None)]
    assert [(x.evidence_id, x.evidence_type, x.start, x.end, x.source_reference, x.association) for x in r.evidence] == [("E1", "palaeography", -200, 100, "r1", None), ("E2", "stratigraphy", None, None, "annotator_observation", "same_context_insecure")]
    assert [tuple(x) for x in r.references] == [("r1", "p. 5", "verified_against_source"), ("r2", None, "unverified")]
    assert [tuple(x) for x in r.alternatives] == [("ki", "r2"), ("ku", "this_annotator")] and [tuple(x) for x in r.usability] == [("i1", "yes")]


@pytest.mark.parametrize(("rows", "want"), [
    ([row(annotator_id="", reading="x")], [(2, "annotator_id", "answers without an annotator")]),
    ([row(image_id="")], [(2, "image_id", "missing")]),
    ([row(dating_range="about 100")], [(2, "dating_range", "not start..end in signed years: about 100")]),
    ([row(dating_evidence="palaeography; a; 1..2")], [(2, "dating_evidence", "item 1: not 'type; observation; start..end or -; source'")]),
    ([row(dating_evidence="palaeography; a; -; r1 | palaeography; a; soon; r1")], [(2, "dating_evidence", "item 2: not start..end in signed years: soon")]),
    ([row(script_type="a"), row(image_id="i2", script_type="b"), row(artifact_id="B", script_type="c")], [(2, "script_type", "differs between rows of one artifact")]),
    ([row(review_state="expert_reviewed")], [(2, "review_state", "not for a project annotator")]),
    ([row(references="r1;nowhere p. 2")], [(2, "references", "unknown reference nowhere")]),
])
def test_what_is_wrong_by_row_and_column(spark, tmp_path, rows, want):
    done = load(spark, tmp_path, *rows)
    assert problems(done) == want
    table = Published(spark, f"file://{tmp_path}/table")
    with pytest.raises(Refused, match=f"row {want[0][0]}, {want[0][1]}"):
        W.commit(done, table)
    assert table.version() == -1


def test_revisions_and_commits(spark, tmp_path):
    before = [("A", "me", "ann_1"), ("A", "you", "ann_2")]
    assert problems(load(spark, tmp_path, row(reading="x"), current=before)) == [(2, "annotator_id", "has annotated this already: ann_1")]
    done = load(spark, tmp_path, row(reading="x", review_state="expert_reviewed"), row(artifact_id="B", reading="y"), current=before, revise=True, expert=True)
    table = Published(spark, f"file://{tmp_path}/table")
    assert problems(done) == [] and W.commit(done, table) == 2
    assert sorted((r.artifact_id, r.supersedes, r.review_state) for r in table.read().collect()) == [("A", "ann_1", "expert_reviewed"), ("B", None, None)]
    assert problems(load(spark, tmp_path, row(), row(image_id="i2"), row(image_id="i3"), image_rows=2)) == [(2, "image_id", "too many rows of one artifact")]
    assert load(spark, tmp_path).rows.count() == 0


def test_checklist(spark, tmp_path):
    cells = spark.createDataFrame([(2, "r1", "c1", "ok", None, "x"), (3, "r1", "", "ok", "me", "x"), (4, "r2", None, "", "me", "x"), (5, "", "c", "odd", "me", "x"), (6, "r1", "c1", "ok", "", "x")], "row long, ref_id string, claim_id string, `status (one of)` string, verifier string, n string")
    current = spark.createDataFrame([("r1", "c1", "v1"), ("r1", "c1", "v2"), ("r9", "c1", "v9")], "ref_id string, claim_id string, verification_id string")
    done = W.import_checklist(cells, current, ["ok"], {"verifier": "not_applicable"})
    assert problems(done) == [(5, "ref_id", "missing"), (5, "status", "unknown odd"), (6, "claim_id", "checked twice in one sheet")]
    assert sorted((r.row, r.claim_id, r.verifier, r.supersedes) for r in done.rows.where(F.col("ref_id") == "r1").collect()) == [(2, "c1", "not_applicable", "v2"), (3, "not_applicable", "me", None), (6, "c1", "not_applicable", "v2")]
    assert [r.row for r in done.skipped.collect()] == [4]
