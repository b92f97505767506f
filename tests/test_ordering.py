"""Running sums by ranges against a window over each group."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from curata.operators.ordering import running_sums
from tests.oracle import rows


@pytest.mark.parametrize("by", [0, 1, 2])
def test_running_sums_are_those_of_a_window(spark, by):
    r = random.Random(by)
    data = [(r.choice(["a", "b", None, "hot", "hot", "hot"]), r.choice([1, 2, None]), i, r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "g string, s int, i int, v long").repartition(7)
    keys = ["g", "s", "i"]
    got = running_sums(df, keys, {"total": "v", "n": None}, by=by)
    w = Window.partitionBy(*(keys[:by] or [F.lit(1)])).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("total", F.sum("v").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    assert rows(got) == rows(want)
    assert running_sums(df, keys, {"n": None}, row_id="x").select("x").distinct().count() == 500


def test_no_rows_and_one_group_over_all_ranges(spark):
    df = spark.range(0, 300).select(F.lit("x").alias("g"), "id", F.lit(1).cast("long").alias("v"))
    assert running_sums(df.limit(0), ["g", "id"], {"t": "v"}, by=1).count() == 0
    assert {(r.id, r.t) for r in running_sums(df, ["g", "id"], {"t": "v"}, by=1).collect()} == {(i, i + 1) for i in range(300)}


def test_a_bound_of_rows_leaves_the_sums_as_they_are(spark):
    r = random.Random(7)
    df = spark.createDataFrame([(r.choice(["a", None, "hot"]), i, r.randint(0, 9)) for i in range(300)], "g string, i int, v long").repartition(5)
    got = running_sums(df, ["g", "i"], {"t": "v", "n": None}, by=1, row_id="x", rows=300)
    assert rows(got.drop("x")) == rows(running_sums(df, ["g", "i"], {"t": "v", "n": None}, by=1))
    assert got.select("x").distinct().count() == 300
    assert got.agg(F.max("x")).first()[0] < 1 << 40  # one range: ids of later ones begin there
