"""How a query goes about its work: what is computed once, and what is not sent to the driver."""

import random

import pytest

import __spark_entry__ as entry
from curata.operators import dating, identity
from tests.oracle import SMALL


def test_regroup_hashes_texts_once(spark, monkeypatch):
    plain, calls = identity.simhash, []
    monkeypatch.setattr(identity, "simhash", lambda *a, **b: calls.append(1) or plain(*a, **b))
    out = entry.queries()["component_regroup"](spark, SMALL)
    assert out.count() > 0 and len(calls) == 1


def test_components_broadcast_no_keys(spark, monkeypatch):
    plain, plans = identity.near_links, []

    def near_links(*a, **b):
        members, links = plain(*a, **b)
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return members, links

    monkeypatch.setattr(identity, "near_links", near_links)
    assert entry.queries()["near_dup_components"](spark, SMALL).count() > 0
    assert "SortMergeJoin [k" in plans[0] and "BroadcastHashJoin [k" not in plans[0]


@pytest.mark.parametrize(("name", "shuffles"), [("dating_evidence", 4), ("dating_estimate", 6), ("object_statements", 9)])
def test_lines_are_read_and_shuffled_once(spark, name, shuffles):
    """Lines and objects by object, two small tables of references; then totals of an object and each table of an object's that is joined to them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning") <= shuffles


def test_weigh_keeps_objects_whole(spark):
    """Against a plain loop, with an object of a third of all evidence, where partitions may be split and put together as Spark likes; none without an object is used."""
    r = random.Random(4)
    kinds, cited = [*dating.STRENGTH, "odd", None], ["annotator_observation", "known", "unknown", None]
    bound = lambda: r.choice([None, *range(-300, 300)])
    rows = [(0 if i % 3 == 0 else None if i % 50 == 1 else r.randint(1, 60), f"e{i}", r.choice(kinds), r.choice(["expert_annotation", "ai_prediction"]), r.choice(["direct", "far"]), r.choice(cited), "low", bound(), bound()) for i in range(900)]
    evidence = spark.createDataFrame(rows, "o long, item string, evidence_type string, provenance string, association string, source_reference string, confidence string, start int, end int").repartition(7)
    objects = spark.createDataFrame([(i, "excavated_stratified" if i % 2 else None) for i in range(50)], "o long, context string")
    tight = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    before = {k: spark.conf.get(k) for k in tight}
    for k, v in tight.items():
        spark.conf.set(k, v)
    try:
        got = {x.item: x for x in dating.weigh(evidence, objects, spark.createDataFrame([("known", dating.VERIFIED)], "ref_id string, status string"), "o", "item").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want, ranges = {}, {}
    tier = lambda x: dating.STRENGTH.get(x[2], dating.LAST)
    for x in sorted(rows, key=lambda x: (tier(x), x[1])):
        o, item, start, end = x[0], x[1], x[7], x[8]
        if got[item].excluded is not None or o is None:
            continue
        low, high = ranges.get(o, (None, None))
        low, high = max((v for v in (low, start) if v is not None), default=None), min((v for v in (high, end) if v is not None), default=None)
        want[item] = low is None or high is None or low <= high
        if want[item]:
            ranges[o] = low, high
    assert len(got) == len(rows) and {k: x.used for k, x in got.items()} == {x[1]: want.get(x[1]) for x in rows} and set(want.values()) == {True, False}
    assert {k: (x.tier, x.category) for k, x in got.items()} == {x[1]: (tier(x), dating.CATEGORY.get(x[2], dating.UNCERTAIN)) for x in rows}
