"""As-of joins, first rows and state machines against plain versions, over many ranges and small batches."""

import random

import pytest
from pyspark.sql import functions as F

from curata.operators import acquisition as A
from curata.operators.ordering import first_n, latest_before


@pytest.fixture
def narrow(spark):
    """Batches of seven rows and nine ranges."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.shuffle.partitions": "9"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_latest_before(narrow, seed):
    """A key of half the rows, keys on one side alone, null keys and times, equal times, columns with names that the operator uses."""
    r = random.Random(seed)
    key = lambda: r.choice(["hot", "hot", "hot", "a", "b", None, *(str(i) for i in range(4))])
    left = [(i, key(), r.choice([None, *range(60)]), "l") for i in range(300)]
    right = [(key(), r.choice([None, *range(0, 60, r.choice((1, 7)))]), r.randint(0, 9), f"r{i}") for i in range(r.choice((0, 5, 120)))]
    a, b = narrow.createDataFrame(left, "id long, k string, t int, mark string"), narrow.createDataFrame(right, "k string, t int, part int, row string")
    got = {x.id: (x.part, x.row) for x in latest_before(a, b, "k", "t", ["part", "row"]).collect()}
    assert len(got) == len(left)
    for i, k, t, _ in left:
        fits = [(x[1], x[2], x[3]) for x in right if k is not None and t is not None and x[0] == k and x[1] is not None and x[1] <= t]
        assert got[i] == (max(fits)[1:] if fits else (None, None)), (i, k, t)


def test_latest_before_of_no_rows(spark):
    a, b = spark.createDataFrame([], "k string, t int"), spark.createDataFrame([("a", 1, 2)], "k string, t int, v int")
    assert latest_before(a, b, "k", "t", ["v"]).count() == 0
    assert [tuple(x) for x in latest_before(b.select("k", "t"), b.limit(0), "k", "t", ["v"]).collect()] == [("a", 1, None)]


def test_first_n_is_limited_within_tasks(spark):
    df = spark.range(0, 5000, 1, 8).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 100).alias("w"), F.col("id").alias("i"))
    out = first_n(df, 5, [F.desc("w")], ["g"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    got = sorted((x.g, x.place, x.w, x.i) for x in out.collect())
    rows = [(i % 3, i * 7919 % 100, i) for i in range(5000)]
    assert got == [(g, n, w, i) for g in range(3) for n, (_, w, i) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))[:5], 1)]
    assert [(x.place, x.w, x.i) for x in first_n(df.repartition(3), 3, [F.desc("w")]).orderBy("place").collect()] == [(n, w, i) for n, (_, w, i) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0], x[2]))[:3], 1)]
    for n in (0, 1001):
        with pytest.raises(ValueError):
            first_n(df, n, ["w"])


def test_states_fold_and_batches_are_taken_back(narrow):
    r = random.Random(3)
    says = ["planned", "fetched", "checked", "failed", "rejected", "odd", None]
    log = [(r.choice(["x", "y", None]), r.randint(0, 5), i, r.choice(says)) for i in range(600)]
    log += [("z", 1, 1, "planned"), ("z", 1, 2, "fetched"), ("z", 1, 3, "checked"), ("z", 2, 1, "planned"), ("z", 2, 2, "fetched"), ("z", 2, 3, "checked"), ("z", 2, 4, "failed"), ("w", 1, 1, "planned"), ("w", 1, 2, "failed"), ("w", 2, 1, "present")]
    r.shuffle(log)
    items = A.fold_states(narrow.createDataFrame(log, "batch string, item int, seq int, event string"), ["batch", "item"], "seq", "event")
    plain = {}
    for b, i, _, e in sorted(log, key=lambda x: x[2]):
        state, n, bad = plain.get((b, i), ("", 0, 0))
        plain[b, i] = (A.STEPS.get((state, e), state), n + 1, bad + ((state, e) not in A.STEPS))
    assert {(x.batch, x.item): (x.state, x.n_events, x.n_ignored) for x in items.collect()} == plain
    done = A.outcomes(items, ["batch"])
    spoiled = {b for (b, _), x in plain.items() if x[0] == "refused"}
    assert {(x.batch, x.item): x.outcome for x in done.collect()} == {k: "rolled_back" if k[0] in spoiled and x[0] == "acquired" else x[0] for k, x in plain.items()}
    assert plain["z", 1][0] == "acquired" and {x.outcome: x.n for x in A.report(done.where("batch = 'z'"), ["batch"]).collect()} == {"rolled_back": 1, "refused": 1}
    assert A.fold_states(narrow.createDataFrame([], "batch string, seq int, event string"), ["batch"], "seq", "event").count() == 0
