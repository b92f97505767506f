"""User functions by name, and grids of perturbations."""

import pytest
from pyspark.sql import functions as F

from curata.functions import engines as E


def docs(spark):
    return spark.createDataFrame([(i, None if i == 7 else "some text " * i, "clash") for i in range(20)], "i long, t string, family_ string")


def test_a_kind_without_an_engine_says_so(spark):
    out = E.Registry().apply(docs(spark), "transcriber", "t").collect()
    assert len(out) == 20 and {(r.engine, r.version, r.status, r.text, r.score) for r in out} == {("no_engine", None, None, None, None)}


def test_engines_are_made_once_a_task_and_held_to_their_columns(spark):
    reg = E.Registry()
    reg.add(E.Engine("size", "classifier", "2", lambda: lambda texts: [(None if t is None else str(len(t)), 0.5) for t in texts]))
    got = {r.i: (r.engine, r.version, r.label, r.score) for r in reg.apply(docs(spark).repartition(3), "classifier", "t").collect()}
    assert got == {i: ("size", "2", None if i == 7 else str(10 * i), 0.5) for i in range(20)}
    assert reg.apply(docs(spark).limit(0), "classifier", "t").count() == 0
    boxes = E.Engine("box", "detector", "1", lambda: lambda texts: [([{"x": 0.0, "y": 0.0, "w": 1.0, "h": 1.0, "score": 0.9}],) for _ in texts])
    reg.add(boxes)
    assert reg.apply(docs(spark), "detector", "t", "box").first().boxes[0].score == 0.9
    for bad in (boxes, E.Engine("x", "painter", "1", lambda: None)):
        with pytest.raises(ValueError):
            reg.add(bad)
    reg.add(E.Engine("other", "classifier", "1", lambda: lambda texts: [("x",)] * len(texts)))
    for kind, name in (("classifier", None), ("classifier", "gone"), ("painter", None)):
        with pytest.raises(ValueError):
            reg.apply(docs(spark), kind, "t", name)
    with pytest.raises(ValueError):
        reg.apply(docs(spark).withColumnRenamed("family_", "label"), "classifier", "t", "size")
    with pytest.raises(Exception, match="other columns"):
        reg.apply(docs(spark), "classifier", "t", "other").collect()


def test_grids_are_the_same_on_every_layout(spark):
    a, b = (sorted(map(tuple, E.grid(docs(spark).repartition(n), "i", "t").collect()), key=repr) for n in (1, 5))
    assert a == b and len(a) == 20 * len(E.TEXTUAL)
    by = {(r[0], r[3]): r[1] for r in a}
    assert by[3, "clean"] == "some text " * 3 and by[3, "no_vowels"] == "sm txt " * 3 and by[3, "first_half"] == ("some text " * 3)[:15] and by[7, "dropped_20"] is None
    assert 0.6 < sum(len(by[i, "dropped_20"]) for i in range(8, 20)) / sum(10 * i for i in range(8, 20)) < 0.95
    assert len({by[i, "dropped_5"] for i in range(10, 20)}) == 10
    with pytest.raises(ValueError):
        E.grid(docs(spark), "i", "t", [E.CLEAN, E.CLEAN])


def test_robustness_counts_nulls_as_wrong(spark):
    said = E.grid(docs(spark), "i", "t", E.TEXTUAL[:3]).withColumn("right", F.length("t") >= 50)
    got = {r.perturbation: (r.n, r.n_right, round(r.drop_from_clean, 9)) for r in E.robustness(said, "right").collect()}
    assert got == {"clean": (20, 14, 0.0), "no_vowels": (20, 12, 0.1), "first_half": (20, 10, 0.2)}
