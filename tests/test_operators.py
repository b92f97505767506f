"""Semantics that the tables do not show: rules one by one, traps, undefined values, matchers against brute force."""

import collections
import hashlib
import json
import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from curata.functions import absence as A
from curata.functions import scalars as S
from curata.operators import annotations, dating, evidence, identity, metrics, rules, sampling, splits
from curata.operators.rules import Field
from curata.plans import storage

# -- absence -----------------------------------------------------------------------------------------------------------


def test_absent_null_and_sentinel_differ(spark):
    df = spark.createDataFrame([('{"a":null}',), ('{"b":1}',), ('{"a":"unknown"}',), ('{"a":"x"}',)], "raw string").withColumn("v", F.parse_json("raw"))
    text = F.try_variant_get("v", "$.a", "string")
    out = [tuple(r) for r in df.select(A.is_present(F.col("raw"), "a"), A.is_null_value(F.col("v"), "a"), A.has_real_text(text)).collect()]
    assert out == [(True, True, False), (False, False, False), (True, False, False), (True, False, True)]


# -- record rules ---------------------------------------------------------------------------------------------------------

BASE = {
    "image_id": "img1", "artifact_id": "art1", "image_path": "a/b.jpg", "script_type": "tamil_brahmi", "inscription_present": "yes", "redistributable": "yes", "label_source": "published",
    "image_width_px": 1200, "image_height_px": 900, **{f: "x" for f in rules.RECOMMENDED if f != "dating_basis"}, "dating_basis": ["style"], "dating_source": "book",
}
FIELDS = [
    Field("image_id", required=True, pattern="^[A-Za-z0-9]+$"), Field("view", enum=("x", "y")), Field("dating_lower_year", "int", nullable=True, low=-3000, high=2100, not_zero=True), Field("site"), Field("dating_basis", "array_str", enum=("style", "stratigraphy"), min_items=1),
    *[Field(n) for n in BASE if n not in ("image_id", "view", "site", "dating_basis", "image_width_px", "image_height_px")], Field("image_width_px", "int"), Field("image_height_px", "int"), Field("dating_upper_year", "int", nullable=True), Field("flag", "boolean"), Field("regions", "array_obj"),
    Field("share", "number", low=0, high=1), Field("split"), Field("split_exclusion_reason"), Field("schema_version"), Field("inscription_regions", "array_obj"), Field("script_type_other_detail"), *[Field(n) for n in rules.READING],
]


def findings(spark, change, drop=(), export=False):
    record = {k: v for k, v in (BASE | change).items() if k not in drop}
    df = spark.createDataFrame([(0, json.dumps(record))], "i long, raw string")
    return sorted((r.rule, r.field) for r in rules.record_findings(df, "i", "raw", FIELDS, export).collect())


@pytest.mark.parametrize(
    ("change", "drop", "want"),
    [
        ({}, (), []),
        ({"site": ""}, (), [("E1", "site")]),
        ({}, ("image_id",), [("E1", "image_id")]),
        ({"dating_lower_year": 0}, (), [("E1", "dating_lower_year")]),
        ({"dating_lower_year": None}, (), []),
        ({"dating_lower_year": "5"}, (), [("E1", "dating_lower_year")]),
        ({"view": "z"}, (), [("E1", "view")]),
        ({"typo": 1}, (), [("E1", "typo")]),
        ({"dating_basis": []}, (), [("E1", "dating_basis")]),
        ({"dating_basis": ["luck"]}, (), [("E1", "dating_basis")]),
        ({"share": 1.5}, (), [("E1", "share")]),
        ({"flag": "yes"}, (), [("E1", "flag")]),
        ({"dating_lower_year": 300, "dating_upper_year": -200}, (), [("R8", "dating_lower_year")]),
        ({"dating_lower_year": 300.0, "dating_upper_year": -200}, (), []),  # whole for the schema, no integer for the rule
        ({"dating_lower_year": 5, "dating_source": "unknown"}, (), [("R9", "dating_source")]),
        ({"inscription_present": "no"}, (), [("R5", "script_type")]),
        ({"script_type": "none", "transcription": "abc", "translation_en": "not_applicable"}, (), [("R6", "transcription")]),
        ({"script_type": "other_script", "script_type_other_detail": "unknown"}, (), [("R7", "script_type_other_detail")]),
        ({"dating_basis": ["stratigraphy"], "context_reliability": "surface"}, (), [("R10", "context_reliability")]),
        ({"split": "excluded", "split_exclusion_reason": "not_available"}, (), [("R12", "split_exclusion_reason")]),
        ({"split": "test", "label_source": "project_annotation_unverified"}, (), [("R14", "label_source")]),
        ({"inscription_regions": [{"x": 1100, "y": 0, "w": 400, "h": 10}]}, (), [("R13", "inscription_regions.0")]),
        ({"inscription_regions": [{"x": 1100, "y": 0, "w": 100, "h": 10}]}, (), []),
        ({"schema_version": "2.1"}, (), [("E4", "schema_version")]),
        ({"image_path": "..\\x"}, (), [("E3", "image_path"), ("E3", "image_path")]),
        ({"image_path": "C:x"}, (), [("E3", "image_path")]),
        ({}, ("view", "annotator"), [("R15", "annotator"), ("R15", "view")]),
    ],
)
def test_one_rule_at_a_time(spark, change, drop, want):
    assert findings(spark, change, drop) == want


def test_export_and_broken_lines(spark):
    assert findings(spark, {"redistributable": "unknown"}, export=True) == [("R11", "redistributable")]
    df = spark.createDataFrame([(0, "no json"), (1, "[1]"), (2, None)], "i long, raw string")
    out = rules.record_findings(df, "i", "raw", FIELDS)
    assert sorted((r.record_index, r.rule, r.field) for r in out.collect()) == [(0, "E1", None), (1, "E1", None), (2, "E1", None)]
    v = rules.verdict(out).first()
    assert (v.n_errors, v.ok) == (3, False) and rules.verdict(out.limit(0)).first().ok
    texts = [r.rule for r in rules.sort_findings(spark.createDataFrame([("R2", 1, "a"), ("R10", 1, "a"), ("R3", None, "a")], "rule string, record_index long, field string")).collect()]
    assert texts == ["R10", "R2", "R3"]


def test_third_owner_is_a_leak_again(spark):
    df = spark.createDataFrame([(0, "i0", "A", "h"), (1, "i1", "B", "h"), (2, "i2", "B", "h"), (3, "i3", "A", "h"), (4, "i4", "C", "unknown"), (5, "i5", "D", "unknown")], "i long, item string, g string, h string")
    assert sorted((r.rule, r.record_index) for r in identity.duplicate_findings(df, "i", "item", "g", "h").collect()) == [("E5", 3), ("R4", 1), ("R4", 2)]


def test_near_pairs_are_all_pairs(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(20)]
    bits = []
    for i in range(300):
        x = r.choice(base)
        for _ in range(r.randrange(9)):
            x ^= 1 << r.randrange(64)
        bits.append((i, i % 4, x - 2**64 if x >= 2**63 else x))
    df = spark.createDataFrame(bits, "item long, g int, bits long")
    for d in (0, 3, 7):
        want = {(a, b, (x ^ y).bit_count() if (x ^ y) >= 0 else ((x ^ y) + 2**64).bit_count()) for a, g, x in bits for b, h, y in bits if a < b and g != h}
        want = {p for p in want if p[2] <= d}
        assert {tuple(p) for p in identity.near_pairs(df, "item", "g", "bits", d).collect()} == want
    one = min(want)
    allowed = spark.createDataFrame([(one[1], one[0])], "a long, b long")
    assert {tuple(p) for p in identity.near_pairs(df, "item", "g", "bits", 7, allowed).collect()} == want - {one}


def test_fingerprint_knows_no_order(spark):
    df = spark.range(500).withColumn("x", F.col("id") % 7)
    one = identity.fingerprint(df, "id", F.col("x").cast("string"), "h").first()
    two = identity.fingerprint(df.orderBy(F.desc("id")).repartition(7), "id", F.col("x").cast("string"), "h").first()
    other = identity.fingerprint(df.withColumn("x", F.when(F.col("id") == 3, 9).otherwise(F.col("x"))), "id", F.col("x").cast("string"), "h").first()
    assert one == two and one.fingerprint != other.fingerprint


# -- splits ---------------------------------------------------------------------------------------------------------------


def slow_deal(n, ratios):
    counts, out = [0] * len(ratios), []
    if n >= len(ratios):
        for i in sorted(range(len(ratios)), key=lambda i: -ratios[i]):
            out.append(i)
            counts[i] += 1
    while len(out) < n:
        t = sum(counts) + 1
        i = max((ratios[i] * t - counts[i], -i) for i in range(len(ratios)))[1]
        counts[-i] += 1
        out.append(-i)
    return out


@pytest.mark.parametrize("ratios", [[0.7, 0.15, 0.15], [0.2] * 5, [0.34, 0.33, 0.33]])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 450])
def test_assign_deals_as_told(spark, ratios, n):
    names = [f"p{i}" for i in range(len(ratios))]
    g = spark.range(n).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("grp"), F.lit("c").alias("label"), (F.col("id") % 3).cast("string").alias("stratum"))
    out = splits.assign(g, "grp", "label", "stratum", names, ratios).orderBy("position").collect()
    assert [r.partition for r in out] == [names[i] for i in slow_deal(n, ratios)]
    turns = [r.stratum for r in out[:3]]
    assert len(set(turns)) == min(3, n)  # strata in turn


def test_refusals(spark):
    g = spark.createDataFrame([("a",)] * 25 + [("b",)] * 7, "label string")
    assert tuple(splits.splittable(g, "label", ["a", "b"], 20, 5).first()) == ("grouped_kfold", "")
    assert "no groups of c" in splits.splittable(g, "label", ["a", "b", "c"], 20, 5).first().problems
    assert "holdout needs" in splits.splittable(g, "label", ["a", "b"], 20, 5, "holdout").first().problems


# -- annotations -------------------------------------------------------------------------------------------------------------


def test_ledger_chain_and_tampering(spark):
    lines = [("l", i, f"line {i}") for i in range(5)]
    df = spark.createDataFrame(lines, "log string, n int, line string")
    head = annotations.GENESIS
    for _, _, x in lines:
        head = hashlib.sha256((head + hashlib.sha256(x.encode()).hexdigest()).encode()).hexdigest()
    sealed = annotations.ledger_heads(df, "log", ["n"], "line")
    assert sealed.first().head == head
    status = lambda d: annotations.verify_ledger(d, "log", ["n"], "line", sealed).first().status
    assert status(df) == "INTACT"
    for changed in (df.where("n < 4"), df.withColumn("line", F.when(F.col("n") == 2, "x").otherwise(F.col("line"))), df.unionByName(df.where("n = 4").withColumn("n", F.lit(9)))):
        assert status(changed) == "TAMPERED_OR_UNSEALED"


def test_plan_is_executed_reverted_and_compared(spark):
    records = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", None)], "item long, label string, year int")
    votes = spark.createDataFrame([(1, "x", 5), (1, "x", 5), (2, "y", 7), (2, "z", 7), (3, None, 8)], "item long, label string, year int")
    plan = annotations.promotion_plan(votes, "item", ["label", "year"], records)
    assert sorted((tuple(r) for r in plan.collect()), key=repr) == [(1, "label", "a", "x"), (2, "label", "b", "disputed"), (2, "year", "6", "7"), (3, "year", None, "8")]
    done = annotations.execute_plan(records, plan, "item", ["label", "year"])
    assert sorted(tuple(r) for r in done.collect()) == [(1, "x", 5), (2, "disputed", 7), (3, "c", 8)]
    assert sorted(annotations.execute_plan(done, plan, "item", ["label", "year"], revert=True).collect()) == sorted(records.collect())
    moved = records.withColumn("label", F.when(F.col("item") == 1, "other").otherwise(F.col("label")))
    assert annotations.execute_plan(moved, plan, "item", ["label", "year"]).where("item = 1").first().label == "other"
    assert annotations.plan_digest(plan, "item").first() == annotations.plan_digest(plan.repartition(3), "item").first()


# -- metrics --------------------------------------------------------------------------------------------------------------------


def test_undefined_metrics_are_null(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0)], "y int, p int")
    out = {r.label: r for r in metrics.per_class(metrics.confusion(df, "y", "p"), range(4)).collect()}
    assert (out[2].precision, out[2].recall, out[2].f1) == (None, None, None)
    never = {r.label: r for r in metrics.per_class(metrics.confusion(spark.createDataFrame([(0, 1), (1, 1)], "y int, p int"), "y", "p"), range(3)).collect()}
    assert (never[0].precision, never[0].recall, never[0].f1) == (0.0, 0.0, 0.0)
    empty = spark.createDataFrame([], "a string, b string")
    assert tuple(metrics.kappa(empty, "a", "b").first()) == (0, 0, 0, None, None, "no_data")
    same = spark.createDataFrame([("x", "x")] * 40, "a string, b string")
    assert metrics.kappa(same, "a", "b").first().status == "undefined"


def test_bin_edges(spark):
    df = spark.createDataFrame([(0, [x, 0.0]) for x in (0.0, 0.1, 0.10001, 0.5, 1.0)], "y int, p array<double>")
    assert {r.bin: r.n for r in metrics.calibration(df, "y", "p").collect() if r.n} == {0: 2, 1: 1, 4: 1, 9: 1}
    assert {r.bin: r.n for r in metrics.confidence_bins(df, "y", "p").collect()} == {0: 3, 1: 1, 2: 0, 3: 1}


def test_temperature_of_sharpened_probabilities(spark):
    r = random.Random(2)
    data = []
    for _ in range(1500):
        p = [0.7, 0.2, 0.1]
        y = r.choices(range(3), weights=p)[0]
        q = [x**2 for x in p]
        data.append((y, [x / sum(q) for x in q]))
    t = metrics.fit_temperature(spark.createDataFrame(data, "y int, p array<double>"), "y", "p")
    assert 1.6 < t < 2.5


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_text_distances(spark):
    pairs = [("சோதனை", "சோதன"), ("é", "e"), ("the cat sat", "the cat sat down"), ("a b c", "c b a"), ("one two", ""), ("", "x"), ("  spaced   out ", "spaced out"), (" ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(5, 300)))]
    df = spark.createDataFrame(pairs, "r string, h string")
    out = df.select("r", "h", S.word_distance(F.col("r"), F.col("h")).alias("w"), F.levenshtein("r", "h").alias("c"), S.char_error_rate(F.col("r"), F.col("h")).alias("e"), S.char_similarity(F.col("r"), F.col("h")).alias("s")).collect()
    for r in out:
        assert r.w == levenshtein(r.r.split(), r.h.split()) and r.c == levenshtein(r.r, r.h)
        assert r.e == (r.c / len(r.r) if r.r else None)
    text = "Straße  é X"
    assert spark.createDataFrame([(text,)], "t string").select(S.normalise_reading("t")).first()[0] == " ".join(unicodedata.normalize("NFC", text).split()).casefold()


# -- evidence -----------------------------------------------------------------------------------------------------------------------


def test_fold_skips_conflicts_and_goes_on(spark):
    items = [(1, "a", -300, -100), (2, "b", 50, 60), (2, "c", -250, None), (3, "d", None, -120), (0, "e", None, None)]
    df = spark.createDataFrame([("g", *i) for i in items], "g string, tier int, item string, s int, e int")
    r = dating.estimate(df, "g", "tier", "item", "s", "e").first()
    assert (r.state, r.start, r.end, r.used, r.conflicts, r.display) == ("estimated", -250, -120, "a,c,d", "b", "250 BCE – 120 BCE")
    none = dating.estimate(df.where("item = 'e'"), "g", "tier", "item", "s", "e").first()
    assert (none.state, none.display) == ("insufficient_evidence", "Insufficient evidence")


def test_years_and_ranges(spark):
    df = spark.createDataFrame([(-1, 1), (-150, 50), (50, 111), (1, 1)], "a int, b int")
    out = df.select(S.year_span(F.col("a"), F.col("b")), S.century_label(F.col("a")), S.centuries_label(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in out] == [(1, "1st century BCE", "1st century BCE – 1st century CE"), (199, "2nd century BCE", "2nd century BCE – 1st century CE"), (61, "1st century CE", "1st century CE – 2nd century CE"), (0, "1st century CE", "1st century CE")]
    p = spark.createDataFrame([("-300..-100",), ("5 to",), ("x",)], "t string").select(S.parse_range(F.col("t")).alias("r")).select("r.*").collect()
    assert [tuple(x) for x in p] == [(-300, -100), (5, None), (None, None)]
    i = spark.createDataFrame([(1, None, None, 5), (1, 2, 3, 4)], "a int, b int, c int, d int").select(S.common_range(*map(F.col, "abcd")).alias("r")).collect()
    assert tuple(i[0].r) == (1, 5) and i[1].r is None


def test_licence_order(spark):
    texts = ["CC BY-NC-ND 4.0", "CC BY-NC 4.0", "cc0", "CC BY-SA 2.5", "CC BY 4.0 INTERNATIONAL", "PD", "GODL-India", "mine", None, "CC BY-ND 3.0"]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", evidence.license_decision(F.col("t")).alias("d")).orderBy("i").collect()
    assert [r.d.why for r in out] == ["no_derivatives", "non_commercial", "allowed", "allowed", "allowed", "public_domain", "godl", "unknown", "unknown", "no_derivatives"]


CLASSES = {"n": "N", "m": "N", "v": "V", "k": "#", "x": "-"}


def test_grammar(spark):
    cases = [(["n", "m", "v"], "translated", 1, 3), (["k", "n", "k", "m", "v", "x", "n", "n", "v"], "translated", 2, 9), (["n", "m", "v", "n"], "partial", 1, 3), (["v"], "invalid_sequence", 0, 0), (["n", "?"], "unknown_glyph", 0, 0), ([], "insufficient_evidence", 0, 0), (["n", "k", "v"], "invalid_sequence", 0, 0)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, codes array<string>")
    out = df.select("i", evidence.decode(F.col("codes"), CLASSES).alias("d")).orderBy("i").collect()
    assert [(r.d.status, r.d.n_clauses, r.d.n_translated) for r in out] == [c[1:] for c in cases]


def slow_greedy(pred, truth, threshold):
    def iou(a, b):
        w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
        h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        u = a[2] * a[3] + b[2] * b[3] - w * h
        return w * h / u if u > 0 else 0.0

    used_p, used_t, out = set(), set(), []
    for v, i, j in sorted(((iou(p, t), i, j) for i, p in enumerate(pred) for j, t in enumerate(truth)), reverse=True):
        if v >= threshold and i not in used_p and j not in used_t:
            used_p.add(i)
            used_t.add(j)
            out.append((i, j))
    return out


def test_box_matching_is_greedy(spark):
    r = random.Random(6)
    box = lambda: (r.randrange(6), r.randrange(6), r.choice([2, 4]), r.choice([2, 4]))
    images = {k: ([box() for _ in range(r.randrange(7))], [box() for _ in range(r.randrange(7))]) for k in range(60)}
    table = lambda side: spark.createDataFrame([(k, i, tuple(map(float, b))) for k, v in images.items() for i, b in enumerate(v[side])], "image long, i int, box struct<x:double,y:double,w:double,h:double>")
    pred, truth = table(0), table(1)
    for t in (0.3, 0.5):
        m = evidence.greedy_match(pred, truth, "image", "i", "box", t)
        assert sorted((x.image, x.pred_index, x.truth_index) for x in m.collect()) == sorted((k, i, j) for k, (p, q) in images.items() for i, j in slow_greedy(p, q, t))
        n = sum(len(slow_greedy(p, q, t)) for p, q in images.values())
        d = evidence.detection_report(m, pred, truth, "image").first()
        assert (d.tp, d.fp, d.fn) == (n, sum(len(p) for p, _ in images.values()) - n, sum(len(q) for _, q in images.values()) - n)


def test_gates_fail_closed(spark):
    g = evidence.gates(spark.createDataFrame([(0,)], "n int"), [("a", F.lit(True), F.col("n") == 0), ("b", F.lit(False), F.lit(True)), ("c", F.lit(True), F.lit(None).cast("boolean"))])
    assert [r.result for r in g.orderBy("gate_no").collect()] == ["PASS", "NOT_EVALUATED", "FAIL"]
    assert evidence.current_stage(g).first().stage == "b"


# -- samples -----------------------------------------------------------------------------------------------------------------------------


def plain_sample(weights, n, seed=7):
    """Draw by draw: the first item whose running sum passes the digest's point."""
    units = [(i, int(w * 2**40)) for i, w in sorted(weights) if w and w > 0]
    total, times = sum(u for _, u in units), {}
    for k in range(n):
        point, upto = int(hashlib.md5(f"{seed}|{k}".encode()).hexdigest()[:15], 16) % total, 0
        for i, u in units:
            upto += u
            if point < upto:
                times[i] = times.get(i, 0) + 1
                break
    return times


def test_weighted_sample_is_exact(spark):
    weights = [(i, 10.0 if i < 10 else 0.1) for i in range(200)] + [(300, 0.0), (301, None), (302, -1.0)]
    df = spark.createDataFrame(weights, "item long, w double")
    out = {r.item: r.times for r in sampling.weighted_sample(df, "item", "w", 2000).collect()}
    assert out == plain_sample(weights, 2000) == {r.item: r.times for r in sampling.weighted_sample(df.repartition(5), "item", "w", 2000).collect()}
    assert sum(out.values()) == 2000 and 0.8 < sum(v for k, v in out.items() if k < 10) / 2000 < 0.9
    few = spark.createDataFrame([(1, 3.0), (2, 1.0)], "item long, w double")
    assert sum(r.times for r in sampling.weighted_sample(few, "item", "w", 6000).collect()) == 6000  # a mean of thousands a row
    assert sampling.weighted_sample(df.limit(0), "item", "w", 5).count() == 0 and sampling.weighted_sample(df.where("w <= 0"), "item", "w", 5).count() == 0


# -- regrouping ------------------------------------------------------------------------------------------------------------------------------


def plain_regroup(rows, component, seed=7):
    """One swap at a time until no class of a partition has more groups than at first. rows: group -> (label, partition)."""
    order = ["train", "val", "test"]
    now, want = {g: p for g, (_, p) in rows.items()}, collections.Counter((p, label) for label, p in rows.values())
    comps = collections.defaultdict(list)
    for g, c in component.items():
        comps[c].append(g)
    inside = set()
    for gs in (gs for gs in comps.values() if len(gs) > 1):
        inside.update(gs)
        n = collections.Counter(rows[g][1] for g in gs)
        home = min(n, key=lambda p: (-n[p], order.index(p)))
        now.update(dict.fromkeys(gs, home))
    while True:
        have = collections.Counter((p, rows[g][0]) for g, p in now.items())
        over = sorted(k for k in have if have[k] > want[k])
        if not over:
            return now
        p, label = over[0]
        to = sorted(q for q in order if have[q, label] < want[q, label])
        donors = sorted((hashlib.sha256(f"{seed}\x1frebalance\x1f{g}".encode()).hexdigest(), g) for g in now if now[g] == p and rows[g][0] == label and g not in inside)
        if not donors or not to:
            raise ValueError
        now[donors[0][1]] = to[0]


@pytest.mark.parametrize("seed", range(3))
def test_regroup_keeps_components_whole_and_counts_as_they_were(spark, seed):
    r = random.Random(seed)
    rows = {g: (r.choice("ab"), r.choices(["train", "val", "test"], weights=[7, 2, 2])[0]) for g in range(160)}
    component = {g: g // 4 for g in range(24)} | {g: 100 + g % 3 for g in range(30, 42)} | {90: 500}
    a = spark.createDataFrame([(g, label, p) for g, (label, p) in rows.items()], "g long, label string, p string")
    m = spark.createDataFrame(list(component.items()), "g long, c long")
    out = {x.g: x.partition for x in splits.regroup(a, m, "g", "c", "p", "label").collect()}
    assert out == plain_regroup(rows, component)
    tie = splits.regroup(spark.createDataFrame([(1, "a", "test"), (2, "a", "train"), (3, "a", "train"), (4, "a", "test")], "g long, label string, p string"), spark.createDataFrame([(1, 9), (2, 9)], "g long, c long"), "g", "c", "p", "label")
    assert {x.g: x.partition for x in tie.collect()} == {1: "train", 2: "train", 3: "test", 4: "test"}
    with pytest.raises(ValueError, match="restored"):
        splits.regroup(spark.createDataFrame([(1, "a", "test"), (2, "a", "train")], "g long, label string, p string"), spark.createDataFrame([(1, 9), (2, 9)], "g long, c long"), "g", "c", "p", "label")


# -- findings of the review ---------------------------------------------------------------------------------------------------------------------


def test_each_region_outside_is_a_finding(spark):
    record = {"image_width_px": 100, "image_height_px": 50, "inscription_regions": [{"x": 90, "y": 0, "w": 20, "h": 5}, {"x": 0, "y": 0, "w": 5, "h": 5}, {"x": 0, "y": 49, "w": 5, "h": 5}, {"x": 99.0, "y": 0, "w": 20, "h": 5}, "no region", {"x": 99, "y": 0, "w": 20}]}
    df = spark.createDataFrame([(0, json.dumps(record))], "i int, raw string")
    assert sorted(r.field for r in rules.record_findings(df, "i", "raw").where("rule = 'R13'").collect()) == ["inscription_regions.0", "inscription_regions.2"]


def test_claim_report_takes_the_latest_record(spark):
    claims = spark.createDataFrame([(1, "A  claim", ["r"]), (2, "other", ["r", "r"])], "claim_id long, statement string, ref_ids array<string>")
    records = spark.createDataFrame([(1, None, "r", "unverified", 1), (1, None, "r", "verified_against_source", 2), (None, "OTHER", "r", "x", 5), (None, "other", "r", "y", 4)], "claim_id long, claim string, ref_id string, status string, seq int")
    assert sorted(tuple(r) for r in evidence.claim_report(claims, records, "seq").collect()) == [(1, "r", "verified_against_source"), (2, "r", "x")]


def test_a_minus_before_a_digit_is_no_formula(spark):
    df = spark.createDataFrame([("-300..-100",), ("-300",), ("-a",), ("=1",), ("+1",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(S.safe_cell(F.col("s"))).collect()] == ["-300..-100", "-300", "'-a", "'=1", "'+1", "x", None]


def test_temperature_against_a_fine_grid(spark):
    r = random.Random(5)
    rows = [(r.choices(range(3), weights=[0.5, 0.3, 0.2])[0], [0.8, 0.15, 0.05]) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, p array<double>")

    def nll(t):
        total = 0.0
        for y, p in rows:
            e = [x ** (1 / t) for x in p]
            total -= math.log(e[y] / sum(e))
        return total / len(rows)

    best = min((nll(t / 100), t / 100) for t in range(50, 600))[1]
    assert abs(metrics.fit_temperature(df, "y", "p") - best) < 0.02


@pytest.mark.parametrize(("distance", "agree"), [(0, 1), (3, 2), (6, 3), (12, 2)])
def test_near_pairs_are_all_pairs(spark, distance, agree):
    r = random.Random(distance)
    patterns = [r.getrandbits(64) for _ in range(40)]
    for p in patterns[:20]:
        for k in (1, 3, 6, 7, 12, 13):
            q = p
            for b in r.sample(range(64), k):
                q ^= 1 << b
            patterns.append(q)
    rows = [(i, i % 50, p - (1 << 64) if p >= 1 << 63 else p) for i, p in enumerate(patterns)] + [(900, 3, None)]
    want = sorted((i, j, d) for i, gi, p in rows[:-1] for j, gj, q in rows[:-1] if i < j and gi != gj and (d := bin((p ^ q) & (1 << 64) - 1).count("1")) <= distance)
    assert sorted(tuple(x) for x in identity.near_pairs(spark.createDataFrame(rows, "i long, g long, b long"), "i", "g", "b", distance, agree=agree).collect()) == want


def test_storage_needs_a_shared_folder_on_a_cluster(spark, tmp_path):
    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Cluster(), "x")
    df = storage.materialize(spark.range(3), "gone")
    assert df.count() == 3 and storage.discard(spark) >= 1
    with pytest.raises(Exception, match="(?i)not.*exist|FAILED_READ_FILE|file"):
        df.collect()


def test_near_links_are_those_of_all_pairs(spark):
    """Classes of equal patterns, one of them a third of all rows: no pairs within it, and members and links give back every near pair of items."""
    r = random.Random(21)
    base = [r.getrandbits(64) for _ in range(12)]
    rows = [(i, r.randint(0, 3), base[0] if i % 3 == 0 else base[i % 12] ^ sum(1 << r.randint(0, 63) for _ in range(r.choice((0, 1, 4))))) for i in range(180)] + [(999, 1, None)]
    signed = [(i, g, None if b is None else (b & 2**64 - 1) - (1 << 64) if (b & 2**64 - 1) >> 63 else b & 2**64 - 1) for i, g, b in rows]
    members, links = identity.near_links(spark.createDataFrame(signed, "i long, g long, b long"), "i", "g", "b", 6)
    of = {x.i: x.representative for x in members.collect()}
    bits = {i: b & 2**64 - 1 for i, _, b in rows if b is not None}
    group = {i: g for i, g, _ in rows}
    by = {}
    for i, b in bits.items():
        by.setdefault(b, []).append(i)
    assert of == {i: min(by[b]) for i, b in bits.items()}
    assert {x.i: x.crosses for x in members.collect()} == {i: len({group[j] for j in by[b]}) > 1 for i, b in bits.items()}
    want = {(min(min(x), min(y)), max(min(x), min(y)), (a ^ b).bit_count()) for a, x in by.items() for b, y in by.items() if a < b and (a ^ b).bit_count() <= 6 and len({group[i] for i in x + y}) > 1}
    assert {tuple(x) for x in links.collect()} == want and want


def test_shared_passages_by_both_ways(spark):
    """Broadcast and numbered, or joined: as counted by hand, with repeated passages, short texts and words that no marked text has."""
    r = random.Random(5)
    words = "a b c d e".split()
    text = lambda n: " ".join(r.choices(words + ["zz"] * (n > 30), k=n))
    marked = [(f"m{i}", text(r.choice((3, 4, 9)))) for i in range(30)] + [("none", None), ("short", "a b")]
    docs = [(i, text(r.choice((0, 2, 4, 60)))) for i in range(60)] + [(60, None), (61, ""), (62, "a  b c d e")]
    sets = lambda t: {tuple(w[i : i + 4]) for w in [(t or "").split(" ")] for i in range(len(w) - 3)} if t is not None else set()
    want = {(m, i, n) for m, x in marked for i, y in docs if (n := len(sets(x) & sets(y)))}
    a, b = spark.createDataFrame(docs, "i long, text string"), spark.createDataFrame(marked, "m string, text string")
    for rows in (10_000, 3):
        assert {tuple(x) for x in identity.shared_passages(a, "i", "text", b, "m", 4, rows).collect()} == want and want
    assert identity.shared_passages(a, "i", "text", b.limit(0), "m", 4).count() == 0 and identity.shared_passages(a.limit(0), "i", "text", b, "m", 4).count() == 0


def test_simhash_is_the_majority(spark):
    texts = ["a b c d", "a  b", "", None, "x", "one two three one two three one two"]
    got = {r.t: r.bits for r in identity.simhash(spark.createDataFrame([(t,) for t in texts], "t string"), ["t"], "t").collect()}
    for t in texts:
        w = [x for x in (t or "").split(" ") if x]
        s = {" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()
        heads = [int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "big") for x in s]
        bits = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in heads) > len(s))
        assert got[t] == (None if not w else bits - (1 << 64) if bits >> 63 else bits)


def test_positions_from_sizes_and_from_a_second_sort(spark):
    r = random.Random(8)
    rows = [(f"g{i}", r.choice(["x", "y", None]), r.choice(["s", "s", "s", "t", "u", None, f"v{i % 7}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, l string, s string")
    a, b = (sorted(map(tuple, splits.interleave(df, "g", "l", "s", 3, few).collect()), key=repr) for few in (1000, 2))
    assert a == b and sorted(x[3] for x in a if x[1] == "x") == list(range(sum(x[1] == "x" for x in rows)))


def test_keys_of_patterns_are_never_broadcast(spark):
    """Each pattern has dozens of keys, which the estimated size of a side doesn't show: at a million patterns the driver would hold 84 million rows. They are shuffled once for both sides."""
    met = identity.near_patterns(spark.range(400).selectExpr("xxhash64(id div 2) ^ (id % 2) AS b"), 6)
    assert met.count() >= 200
    met.collect()
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin [k" in plan and "ReusedExchange" in plan.split("Initial Plan")[0]
