"""Reports, dating, promotion, gates and phrases on nulls, ties, repeated rows and empty tables."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from curata.functions import phrases as W
from curata.operators import annotations as A
from curata.operators import dating as D
from curata.operators import promotion as P
from curata.operators import readiness as G
from curata.operators import reports as R
from curata.sources import records as S

EVIDENCE = "object string, item string, evidence_type string, provenance string, association string, source_reference string, confidence string, start int, end int"
OBJECTS = "object string, context string, script string, script_provenance string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_audit_of_nulls_and_of_nothing(spark):
    df = spark.createDataFrame([(None, None, None, None, None), ("g", None, "unknown", 1, None), ("g", "a", "h", None, None), ("g", "b", "h", None, 2)], "grp string, label string, digest string, low int, high int")
    out = {(m, k): n for m, k, n in rows(R.audit(df, "grp", "label", "digest", ["digest"], ["label"], ("low", "high")))}
    assert out["records", ""] == 4 and out["without_digest", ""] == 2 and out["with_bound", ""] == 2 and out["digests", ""] == 1 and out["groups", ""] == 1 and out["largest_group", ""] == 3
    assert out["value:label", "<absent>"] == 2 and out["groups_by_label", "a"] == out["groups_by_label", "b"] == 1 and ("groups_by_label", "<absent>") not in out
    assert {m: n for m, _, n in rows(R.audit(df.where("1 = 0"), "grp", "label", "digest", ["digest"], ["label"], ("low", "high")))} == {"groups": 0, "largest_group": 0, "digests": 0}


def test_one_strategy():
    assert R.one_strategy("none") == R.one_strategy(["none"]) == "none" and R.one_strategy(["none", "weighted_sampling"]) == "weighted_sampling"
    for wrong in (["weighted_sampling", "class_weighted_loss"], "other"):
        with pytest.raises(ValueError):
            R.one_strategy(wrong)


def test_batches_over_and_within_budget(spark):
    items = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "gone"), ("b", "z"), ("b", "w")], "batch string, title string")
    described = spark.createDataFrame([("x", "i1", 6, True, None), ("y", "i2", 6, True, None), ("z", "i3", 9, True, None), ("w", "i4", 9, True, None), ("w", "i4", 9, True, None)], "title string, image_id string, size_bytes long, accepted boolean, why string")
    plan = R.acquisition_plan(items, described, spark.createDataFrame([("i4",)], "image_id string"), "batch", "title", 10)
    assert rows(plan.select("title", "status")) == [("gone", "rejected"), ("w", "already_present"), ("x", "rejected"), ("y", "rejected"), ("z", "planned")]
    assert rows(R.acquisition_report(plan, "batch")) == [("a", "rejected", 3, 12), ("b", "already_present", 1, 9), ("b", "planned", 1, 9)]
    assert rows(spark.createDataFrame([("a/b",), (".x",), ("ok.jpg",), (None,), ("",)], "n string").select("n", R.unsafe_file_name(F.col("n")))) == [("", True), (".x", True), ("a/b", True), ("ok.jpg", False), (None, True)]


def test_fold_is_sequential_and_streams_over_batches(spark):
    rows_in = [("o", f"e{i:04d}", "palaeography", "expert_annotation", "direct", "this_annotator", "high", -500 + i, 500 - i) for i in range(600)]
    rows_in += [("p", "e1", "stratigraphy", "expert_annotation", "direct", "r", "high", -100, None), ("p", "e2", "linguistics", "expert_annotation", "direct", "this_annotator", "high", None, -200), ("p", "e3", "linguistics", "expert_annotation", "direct", "this_annotator", None, 10, 20)]
    rows_in += [("q", "e1", None, None, None, None, None, None, None), (None, "e1", "linguistics", "expert_annotation", "direct", "this_annotator", "high", 1, 2)]
    e = spark.createDataFrame(rows_in, EVIDENCE)
    o = spark.createDataFrame([("o", "x", None, None), ("p", "excavated_stratified", None, None), ("q", None, "s", "source_information"), ("r", None, "s", "ai_prediction")], OBJECTS)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        w = D.weigh(e, o, spark.createDataFrame([("r", D.VERIFIED)], "ref_id string, status string"), "object", "item")
        assert rows(w.where("object = 'p'").select("item", "used")) == [("e1", True), ("e2", False), ("e3", True)]
        out = {r.object: r for r in D.estimate_dates(w, o, "object", "s", -300).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert (out["o"].start, out["o"].end, out["o"].n_used, out["o"].n_conflicts, out["o"].confidence) == (0, 0, 501, 99, "low")
    assert (out["p"].start, out["p"].end, out["p"].n_conflicts, out["p"].confidence) == (10, 20, 1, "low")
    assert (out["q"].state, out["q"].start, out["q"].confidence) == ("outer_bound_only", -300, "very_low") and out["r"].state == "insufficient_evidence"


def test_high_confidence_needs_everything(spark):
    o = spark.createDataFrame([("p", "excavated_stratified", None, None)], OBJECTS)
    pair = [("p", "e1", "stratigraphy", "expert_annotation", "direct", "r", "high", -100, None), ("p", "e2", "linguistics", "expert_annotation", "direct", "this_annotator", "low", None, 50)]
    level = lambda items, refs: D.estimate_dates(D.weigh(spark.createDataFrame(items, EVIDENCE), o, spark.createDataFrame(refs, "ref_id string, status string"), "object", "item"), o, "object", "s", -300).first().confidence
    assert level(pair, [("r", D.VERIFIED)]) == "high" and level(pair, [("r", "unverified")]) == "low" and level(pair[:1], [("r", D.VERIFIED)]) == "low"
    assert level([pair[0], (*pair[1][:3], "project_annotation", *pair[1][4:])], [("r", D.VERIFIED)]) == "low"


def test_no_estimate_is_surer_than_its_best_item(spark):
    o = spark.createDataFrame([("p", "excavated_stratified", None, None)], OBJECTS)
    item = lambda i, kind, level: ("p", f"e{i}", kind, "expert_annotation", "direct", "this_annotator", level, -100, 50)
    level = lambda *said: D.estimate_dates(D.weigh(spark.createDataFrame([item(i, k, x) for i, (k, x) in enumerate(zip(("stratigraphy", "linguistics", "palaeography"), said, strict=False))], EVIDENCE), o, spark.createDataFrame([], "ref_id string, status string"), "object", "item"), o, "object", "s", -300).first().confidence
    assert [level("unknown", "unknown"), level("unknown", "very_low"), level("high", "unknown"), level("unknown"), level("very_low")] == ["unknown", "very_low", "high", "unknown", "very_low"]
    assert level("certain", None) == "low"  # no item says a word of the scale


def test_agreed_values_and_refusals(spark):
    experts = spark.createDataFrame([("a", "x  y", 1, 2, "high"), ("a", "x y", 1, 2, "low"), ("b", "x", 1, None, "high"), ("b", "unknown", 1, 3, None), ("c", "x", None, None, "odd"), ("c", "z", None, None, "high")], "item string, reading string, lo int, hi int, sure string")
    assert rows(P.agreed(experts, "item", ["reading"], [("lo", "hi")], "sure")) == [("a", "x y", 1, 2, "low"), ("b", None, None, None, "unknown"), ("c", "disputed", None, None, "unknown")]
    assert rows(P.agreed(experts.where("1 = 0"), "item", ["reading"])) == []


def test_settle_goes_on_until_nothing_is_found(spark):
    """x breaks at once; y breaks only once x is taken back, as both may not be old and new together."""
    records = spark.createDataFrame([("x", "i", "old", Decimal(1)), ("y", "j", "old", Decimal(2)), ("z", "k", "old", Decimal(3))], "record string, item string, label string, price decimal(10,0)")
    changes = spark.createDataFrame([("x", "i", "label", "old", "new"), ("y", "j", "label", "old", "new"), ("z", "k", "label", "old", "fine")], "record string, item string, field string, before string, after string")

    def find(after):
        stale = after.where("record = 'x' AND label = 'old'").select(F.lit("y").alias("record"), F.lit("R2").alias("rule"))
        return after.where("record = 'x' AND label = 'new'").select("record", F.lit("R1").alias("rule")).unionByName(stale)

    left, rejected = P.settle(records, changes, find, "item", "record", ["label"])
    assert rows(left.select("item")) == [("k",)] and rows(rejected) == [("i", "R1"), ("j", "R2")]
    left, rejected = P.settle(records, changes.where("1 = 0"), find, "item", "record", ["label"])
    assert rows(left) == [] and rows(rejected) == []


def test_gates_without_records(spark):
    none = spark.createDataFrame([], "grp string, label string, src string, usable string")
    out = G.readiness_gates(none, spark.createDataFrame([], "rule string, severity string"), none, none, none, ["a"], 2, True, "grp", "label", "src", "usable", F.lit(True))
    assert [r.result for r in out.orderBy("gate_no").collect()] == ["PASS", "FAIL", "FAIL", *["NOT_EVALUATED"] * 8]


def test_detection_of_nothing(spark):
    images = spark.createDataFrame([("i", "a"), ("j", "none")], "image string, label string")
    boxes = spark.createDataFrame([("j", 1)], "image string, i int")
    no_match = spark.createDataFrame([], "image string, pred_index int, truth_index int, iou double")
    assert [tuple(r) for r in G.detection_by_threshold(images, no_match, boxes, boxes.where("1 = 0"), "image").select("threshold", "tp", "fp", "fn", "precision", "recall", "f1", "mean_iou").collect()] == [(0.5, 0, 1, 0, 0.0, None, None, None), (0.75, 0, 1, 0, 0.0, None, None, None)]
    assert rows(G.detection_by_class(images, no_match, boxes, boxes.where("1 = 0"), "image", "label").select("label", "fp", "alarm_rate", "f1")) == [("a", 0, 0.0, 0.0), ("none", 1, 1.0, 0.0)]


def test_phrases(spark):
    df = spark.createDataFrame([(0.9, [["x"], ["m"]]), (None, None), (0.1, [[]]), (0.5, [["s", "q"], ["x", "m"]])], "p double, w array<array<string>>")
    out = df.select(W.confidence_words(F.col("p")).alias("c"), W.sequence_category(F.col("w"), {"s": "stem", "m": "marker", "x": "numeral_like"}, F.lit(False)).alias("s")).select("c", "s.rule").collect()
    assert [r.rule for r in out] == ["R2", "R0", "R0", "R3"] and [(r.c or "").split(" ")[0] for r in out] == ["high", "", "very", "low"]


def test_ledgers_stream_in_order_and_refuse_what_was_changed(spark):
    import hashlib

    lines = [(log, i, f"{log}{i}") for log in ("a", "b", None) for i in range(25)]
    df = spark.createDataFrame(lines, "log string, n int, line string")
    want = {}
    for log, _, line in lines:
        head = want.get(log, A.GENESIS)
        want[log] = hashlib.sha256((head + hashlib.sha256(line.encode()).hexdigest()).encode()).hexdigest()
    heads = A.ledger_heads(df, "log", ["n"], "line")
    assert {r.log: r.head for r in heads.collect()} == want and {r.n_lines for r in heads.collect()} == {25}
    assert rows(A.ledger_heads(df.where("1 = 0"), "log", ["n"], "line")) == []
    known = df.where("log IS NOT NULL")
    new = spark.createDataFrame([("a", 99, "more")], "log string, n int, line string")
    both, entries = A.append_sealed(known, "log", ["n"], "line", A.ledger_heads(known, "log", ["n"], "line"), new)
    assert both.count() == 51 and {r.log: r.n_lines for r in entries.collect()} == {"a": 26, "b": 25}
    with pytest.raises(ValueError, match="'a'"):
        A.append_sealed(known.where("n <> 3 OR log = 'b'"), "log", ["n"], "line", A.ledger_heads(known, "log", ["n"], "line"), new)
    with pytest.raises(ValueError, match="line break"):
        A.append_sealed(known, "log", ["n"], "line", A.ledger_heads(known, "log", ["n"], "line"), new.withColumn("line", F.lit("x\ny")))


def test_predictions_and_exports(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"image_id":"a","label":"x"}\n{"label":"y"}\n')
    df = S.read_predictions(spark, str(tmp_path / "p.jsonl"), "image_id string, label string")
    with pytest.raises(Exception, match="without image_id"):
        df.collect()
    log = spark.createDataFrame([("b", "ai_prediction", "=1", 3), ("a", "expert_annotation", None, None)], "id string, kind string, label string, n int")
    S.export_annotations(log, str(tmp_path / "out"), "kind", ["id"], ["id", "label", "n"])
    cells = S.read_csv(spark, str(tmp_path / "out" / "annotations_current.csv"))
    assert cells.columns[:2] == ["provenance_tier", "is_ai_output"] and rows(cells) == [("ai_prediction", "true", "b", "'=1", "3"), ("expert_annotation", "false", "a", None, None)]
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out" / "annotations_current.jsonl")).collect()]
    assert sorted(lines, key=lambda r: r["id"]) == [{"id": "a", "kind": "expert_annotation"}, {"id": "b", "kind": "ai_prediction", "label": "=1", "n": 3}]
