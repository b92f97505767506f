"""Generated records on any layout, their lock, and what is not as it was made."""

from pyspark.sql import functions as F

from curata.operators import generated as G
from curata.operators import readiness as R

CONFIG = G.Config(seed=3, classes=("a", "b", "c"))


def test_records_and_lock_are_the_same_on_every_layout(spark):
    names = [(f"art{i}",) for i in range(60)]
    make = lambda n, rows: G.generate(spark.createDataFrame(rows, "name string").repartition(n), "name", CONFIG, {"a": "yes", "b": "no"})
    one, two = make(1, names), make(5, names[::-1])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    locked = G.lock(one, CONFIG, "s1")
    assert G.lock_differences(locked, G.lock(two, CONFIG, "s1")).count() == 0
    r = locked.first()
    assert (r.n_artifacts, r.n_records) == (60, one.count()) and {x.label for x in one.collect()} == set("abc")
    alone = {x.record: x.digest for x in make(1, names[7:8]).collect()}
    assert alone and alone.items() <= {x.record: x.digest for x in one.collect()}.items()  # a record depends on its own name alone
    assert {(x.label, x.present) for x in one.collect()} == {("a", "yes"), ("b", "no"), ("c", None)}
    differ = lambda df, config=CONFIG, split="s1": sorted(x.name for x in G.lock_differences(locked, G.lock(df, config, split)).collect())
    assert differ(one.withColumn("tilt", F.col("tilt") + 1)) == ["records_fingerprint"]
    assert differ(one.where("record <> 'SYN-art7-V1'")) == ["by_class", "n_records", "parameters_fingerprint", "records_fingerprint"]
    assert differ(one, G.Config(seed=4, classes=("a", "b", "c"))) == ["config_digest"] and differ(one, split=None) == ["split_digest"]
    assert sorted(x.name for x in G.lock_differences(locked.limit(0), locked).collect()) == sorted(G.LOCKED)
    assert G.lock(one.limit(0), CONFIG).first().n_records == 0


def test_checks_with_the_lock_and_records_made_anew(spark):
    names = spark.createDataFrame([(f"art{i}",) for i in range(9)], "name string")
    rows = G.generate(names, "name", CONFIG)
    bad = rows.withColumn("digest", F.when(F.col("artifact") == "art2", "0").otherwise(F.col("digest"))).where("record <> 'SYN-art3-V1'")
    some = names.where("name IN ('art2', 'art3', 'art4')")
    anew = G.not_reproduced(bad, some, "name", CONFIG)
    n2 = rows.where("artifact = 'art2'").count()
    assert sorted((r.problem, r.record) for r in anew.collect())[-1] == ("missing", "SYN-art3-V1") and anew.count() == n2 + 1
    none, empty = G.not_reproduced(rows, names, "name", CONFIG), spark.createDataFrame([], "rule string, record string")
    files, overlaps = spark.createDataFrame([], "path string, problem string"), spark.createDataFrame([], "part_a string, part_b string, n long")
    foreign = {k: rows.limit(0) for k in ("files", "records", "annotations")}
    check = lambda df, anew: {r.check: r.passed for r in R.generated_checks(empty, df.select(F.col("artifact").alias("group"), "label", "version"), files, overlaps, foreign, 3, G.VERSION, G.lock_differences(G.lock(rows, CONFIG), G.lock(df, CONFIG)), anew).collect()}
    assert {k: check(rows, none)[k] for k in ("V12", "V13", "V14")} == {"V12": True, "V13": True, "V14": True}
    assert {k: check(bad, anew)[k] for k in ("V12", "V13", "V14")} == {"V12": False, "V13": True, "V14": False}
