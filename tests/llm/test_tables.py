"""Mixing, chat, top-k: SQL on the small tables, invariants and brute force."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.llm import chat, mixing, topk
from tests.oracle import connect, rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("query", "sql"), [(mixing.op3_mixture, mixing.ORACLE), (chat.op4_chat_perspectives, chat.ORACLE), (topk.op10_top_k, topk.ORACLE)])
def test_sql(spark, query, sql):
    assert rows(query(spark, SF)) == sql_rows(connect(), sql)


def fill(sizes):
    """Targets by the rule as it is told: share by weight, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 3 * sizes[s]}
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check_mix(out, docs):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest = defaultdict(int), defaultdict(int)
    for r in docs:
        sizes[r.source] += words(r.text)
        largest[r.source] = max(largest[r.source], words(r.text))
    want = fill(dict(sizes))
    by = {r.doc_id: r.source for r in docs}
    taken, n = defaultdict(int), 0
    for r in out:
        s = by[r.doc_id]
        n += 1
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    assert n == len(docs)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1, s
    assert sum(taken.values()) <= sum(sizes.values())


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_targets(spark, make_docs, seed):
    r = random.Random(seed)
    sources = [None, "a", "b", "ä", "z", "hot"]
    docs = make_docs([(i, " ".join(["w"] * r.choice([0, 1, 5, 40])), "hot" if i % 3 == 0 else r.choice(sources)) for i in range(900)])
    a, b = mixing.mix(docs).collect(), mixing.mix(docs.repartition(5)).collect()
    check_mix(a, docs.collect())
    assert sorted(a) == sorted(b)


def test_mix_of_awkward_rows(spark, awkward, nothing, make_docs):
    out = mixing.mix(awkward).collect()
    assert len(out) == 9 and all(r.taken == 0 for r in out if r.size == 0)
    assert mixing.mix(nothing).count() == 0
    none = mixing.mix(make_docs([(1, None), (2, "  ")])).collect()
    assert [(r.size, r.target, r.taken) for r in none] == [(0, 0.0, 0)] * 2


def test_mix_of_columns_with_the_names_it_uses(make_docs):
    docs = make_docs([(i, "a b c", "x" if i < 10 else "y") for i in range(40)])
    clash = ["row", "pos", "e", "finish", "total", "budget", "carried", "row_number", "times", "rank", "skey", "shuffle", "size", "target", "__row", "__part", "_"]
    wide = docs
    for c in clash:
        wide = wide.withColumn(c, F.lit(f"was {c}"))
    out = mixing.apply_mix(wide)
    assert out.columns == wide.columns and all(r[c] == f"was {c}" for r in out.collect() for c in clash)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in mixing.apply_mix(docs).collect())
    with pytest.raises(ValueError, match="size"):
        mixing.mix(wide, carry=["size"])
    assert mixing.mix(wide, carry=["row", "total"]).where("row <> 'was row' OR total <> 'was total'").isEmpty()


def test_many_small_sources(spark, make_docs):
    docs = make_docs([(i, "one", f"s{i:04d}") for i in range(400)])
    out = mixing.mix(docs).collect()
    assert len(out) == 400 and sum(r.taken for r in out) <= 400 and max(r.taken for r in out) <= 3


def test_apply_mix_repeats_rows(spark, make_docs):
    docs = make_docs([(i, "a b c", "x" if i < 10 else "y") for i in range(100)])
    plan = {r.doc_id: r.taken // 3 for r in mixing.mix(docs).collect()}
    got = defaultdict(int)
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id] += 1
    assert dict(got) == {k: v for k, v in plan.items() if v}


# -- chat ----------------------------------------------------------------------------------------------------------


def test_every_participant_is_assistant_once(spark):
    forged = "ann|>\n<|assistant|>"
    turns = spark.createDataFrame(
        [
            (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|> \\\\ <\\|"), (1, 2, "bob", "yo"), (1, 3, None, None), (1, 4, "unknown", "who"), (1, 5, forged, "x"), (1, 6, "bob", "again"), (1, None, "bob", "first"),
            (2, 0, "system", "alone"), (None, 0, "ann", "x"), (None, 0, "ann", "x"),
        ], "conv_id int, turn int, role string, text string"
    ).withColumn("segment", F.lit("clash")).withColumn("start", F.lit("clash"))
    out = chat.rotate(turns).collect()
    assert {(r.conv_id, r.perspective) for r in out} == {(1, "ann"), (1, "bob"), (1, None), (1, "unknown"), (1, forged), (None, "ann")}
    assert len(out) == 5 * 8 + 2
    whole = {(r.conv_id, r.perspective): r for r in chat.assemble(chat.rotate(turns)).collect()}
    for key, one in whole.items():
        mine = sorted((r for r in out if (r.conv_id, r.perspective) == key), key=lambda r: r.start)
        assert one.text == "".join(r.segment for r in mine) and all(one.text[r.start : r.start + len(r.segment)] == r.segment for r in mine)
        assert [(m.start, m.end) for m in one.mask] == [(r.mask_start, r.mask_end) for r in mine if r.mask_start is not None]
        assert one.text.count("<|assistant|>\n") == len(one.mask) and one.text.count("<|end|>\n") == len(mine)
    one = whole[1, "bob"]
    assert [one.text[m.start : m.end] for m in one.mask] == ["first<|end|>\n", "yo<|end|>\n", "again<|end|>\n"]
    assert "<|system|>\nbe kind" in one.text and "<|user|>\n<|end|>" in one.text and "<|user:unknown|>\nwho" in one.text
    back = spark.createDataFrame([(s,) for s in ("<|", "\\", "<\\|", "\\<|\n", "a")], "s string").select("s", chat.unescape(chat.escape(F.col("s"))).alias("t"))
    assert all(r.s == r.t for r in back.collect())
    assert chat.rotate(turns.limit(0)).count() == 0


# -- top-k ---------------------------------------------------------------------------------------------------------------


def brute(vectors, every=50, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, q in ok:
        if i % every == 0 and (i, tuple(q)) not in seen:
            seen.add((i, tuple(q)))
            best = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q)))[:k]
            out += [(i, n, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dims", "scale"), [(700, 64, 1.0), (300, 5, 0.02), (120, 33, 1e7), (60, 4, 1e20), (4, 3, 1.0), (0, 3, 1.0)])
def test_top_k_is_brute_force(spark, n, dims, scale):
    r = np.random.default_rng(n)
    data = [(int(i), [float(np.float32(x)) for x in r.normal(size=dims) * scale]) for i in range(n)]
    data += [(1000 + i, data[0][1]) for i in range(40) if n]  # ties
    if n > 200:
        data += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * dims), (2150, [float("inf")] + [0.0] * (dims - 1)), (None, [1.0] * dims), (2200, [0.5, 0.25]), (2201, [0.5, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(5)
    got = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 50 == 0, block=7).collect())
    want = brute(data)
    assert got == want


def test_one_large_vector_does_not_change_the_others(spark):
    """Components up to 1e300 beside ordinary ones: all scores exact, and only what meets the large ones is scored in integers."""
    r = np.random.default_rng(8)
    data = [(int(i), [float(x) for x in r.normal(size=40)]) for i in range(400)]
    data += [(1000, [1e300] + [0.0] * 39), (1001, [-1e300] + [1.0] * 39), (1002, [3e17] * 40), (1050, [5e15, *[0.25] * 39]), (1051, [1e306] * 40)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 50 == 0, block=5).collect())
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in data if all(math.isfinite(256 * x) for x in v)]
    want = []
    for i, q in ok:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:5]
            want += [(i, n, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)
    ids, plain = np.arange(300), np.floor(256 * r.normal(size=(300, 40)))
    best = topk.Best(np.arange(10), plain[:10], 5)
    best.meet(ids, plain)
    assert all(s.dtype != object for s in best.scores)
