"""Published tables: who comes first, what is refused, what a crash leaves."""

import threading

import pytest
from pyspark.sql import functions as F

from curata.operators import annotations as A
from curata.operators import publication as P
from curata.plans.versions import Conflict, Published, Tampered
from curata.streaming.ingest import ingest_batch, ingest_stream

ROWS = "item string, label string, year int"


@pytest.fixture
def records(spark, tmp_path):
    table = Published(spark, f"file://{tmp_path}/records")
    table.publish(spark.createDataFrame([("a", "x", 1), ("b", None, 2), ("c", "z", None)], ROWS), -1)
    return table


def state(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_stay_and_appends_add(spark, records):
    records.publish(spark.createDataFrame([("d", "w", 4)], ROWS), 0, append=True)
    records.publish(spark.createDataFrame([("e", "v", 5)], ROWS), 1)
    assert [records.read(v).count() for v in range(3)] == [3, 4, 1] and records.version() == 2 and len(records.history()[1]["parts"]) == 2
    with pytest.raises(ValueError):
        records.publish(spark.createDataFrame([("d",)], "item string"), 2, append=True)
    records.publish(None, 2, facts={"said": "nothing new"})
    assert records.read().count() == 1 and records.history()[3]["said"] == "nothing new"


def parts(folder):
    return {p.parent.name for p in folder.rglob("*.parquet")}


def test_of_two_writers_one_is_refused(spark, records, tmp_path):
    """Both plan on version 0 and race for 1; the loser leaves no part behind."""
    for base in range(3):
        got, gate = [], threading.Barrier(2)
        claim = records.claim

        def late(body, chain, gate=gate, claim=claim):
            gate.wait()  # both have written their rows and seen no other
            return claim(body, chain)

        records.claim = late

        def write(n, base=base, got=got):
            try:
                records.publish(spark.createDataFrame([(f"w{n}", None, n)], ROWS), base, append=True)
                got.append("published")
            except Conflict:
                got.append("refused")

        threads = [threading.Thread(target=write, args=(n,)) for n in range(2)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        records.claim = claim
        assert sorted(got) == ["published", "refused"] and records.version() == base + 1
    assert records.read().count() == 6 and len(parts(tmp_path / "records")) == 4
    with pytest.raises(Conflict):
        records.publish(records.read(0), 0)
    with pytest.raises(Conflict):
        records.claim({"version": 3, "parts": [], "schema": {}}, "")


def test_a_broken_log_is_seen(records, tmp_path):
    log = tmp_path / "records" / "log" / f"{0:020d}.json"
    for crc in log.parent.glob("*.crc"):
        crc.unlink()
    log.write_text(log.read_text().replace('"version": 0', '"version": 9'))
    with pytest.raises(Tampered):
        records.read()


def plan_of(rows):
    named = rows.select("item", F.lit("label").alias("field"), F.col("label").alias("before"), F.when(F.col("item") == "a", "new").alias("after"))
    return named.where("item IN ('a', 'c') AND NOT (before <=> after)")


def test_promotion_and_its_reversal(spark, records):
    digest = P.dry_run(records, plan_of, "item")
    for approver, approved in ((None, digest), (" ", digest), ("me", None), ("me", "0" * 64)):
        with pytest.raises(P.Refused):
            P.promote(records, plan_of, "item", ["label", "year"], approver, approved)
    done = P.promote(records, plan_of, "item", ["label", "year"], "me", digest)
    assert (done["version"], done["n_changes"], done["approver"]) == (1, 2, "me")
    assert state(records.read()) == [("a", "new", 1), ("b", None, 2), ("c", None, None)]
    with pytest.raises(P.Refused):
        P.promote(records, plan_of, "item", ["label", "year"], "me", P.dry_run(records, plan_of, "item"))  # nothing left to change
    back = A.plan_digest(P.revert_plan(records, 1, "item"), "item").first().digest
    moved = records.read().withColumn("label", F.when(F.col("item") == "a", "other").otherwise(F.col("label")))
    records.publish(moved, 1)
    with pytest.raises(P.Refused, match="changed since"):
        P.revert(records, 1, "item", ["label", "year"], "me", back)
    records.publish(records.read(1), 2)
    P.revert(records, 1, "item", ["label", "year"], "me", back)
    assert state(records.read()) == state(records.read(0))
    for version in (0, 1, 4, 9):  # no promotion, taken back already, a reversal, not there
        with pytest.raises(P.Refused):
            P.revert_plan(records, version, "item")


def test_a_plan_on_older_records_is_not_executed(spark, records):
    """Records that change between the dry run and the execution change the plan's digest."""
    digest = P.dry_run(records, plan_of, "item")
    records.publish(spark.createDataFrame([("a", "y", 1)], ROWS), 0)
    with pytest.raises(P.Refused, match="digest is now"):
        P.promote(records, plan_of, "item", ["label"], "me", digest)


def test_lines_and_their_seals_are_one_commit(spark, tmp_path):
    table = Published(spark, f"file://{tmp_path}/ledger")
    lines = lambda *rows: spark.createDataFrame(list(rows), "log string, n int, line string")
    P.append_lines(table, lines(("a", 1, "one"), ("b", 1, "uno")), "log", ["n"], "line")
    P.append_lines(table, lines(("a", 2, "two")), "log", ["n"], "line")
    heads = {r.log: r for r in spark.read.parquet(f"{table.folder}/{table.history()[-1]['ledger']}").collect()}
    assert {k: r.n_lines for k, r in heads.items()} == {"a": 2, "b": 1}
    assert state(A.verify_ledger(table.read(), "log", ["n"], "line", spark.createDataFrame(list(heads.values()))).select("log", "status")) == [("a", "INTACT"), ("b", "INTACT")]
    ledger = table.history()[-1]["ledger"]
    table.publish(lines(("a", 3, "slipped in")), 1, append=True, facts={"ledger": ledger})
    with pytest.raises(ValueError, match="sealed"):
        P.append_lines(table, lines(("a", 4, "four")), "log", ["n"], "line")


def find(rows):
    return rows.groupBy("item").count().where("count > 1").select(F.lit("error").alias("severity"), F.col("item").alias("id"))


def test_ingest_is_all_or_nothing(spark, records):
    good, bad = (spark.createDataFrame([(a, "q", 1), ("e", "q", 1)], ROWS) for a in ("d", "a"))
    ok, found = P.ingest(records, bad, find)
    assert not ok and [r.id for r in found.collect()] == ["a"] and records.version() == 0
    assert P.ingest(records, good, find)[0] and records.read().count() == 5
    assert not P.ingest(records, good, find, note=True)[0] and records.read().count() == 5 and records.history()[-1]["action"] == "rejected"


def test_a_stream_killed_after_its_commit_adds_nothing_twice(spark, tmp_path):
    """Each file is a batch: the second is refused whole, the third dies between the table's commit and the stream's; the resumed stream is given it again."""
    source, folder, checkpoint = tmp_path / "in", f"file://{tmp_path}/table", f"file://{tmp_path}/checkpoint"
    source.mkdir()
    for i, names in enumerate(("ab", "ca", "de", "f")):
        (source / f"{i}.json").write_text("\n".join(f'{{"item": "{x}", "label": "l{i}", "year": {i}}}' for x in names))
        stamp = 1_700_000_000 + i
        __import__("os").utime(source / f"{i}.json", (stamp, stamp))
    rows = lambda: spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).json(f"file://{source}")

    def dies(batch, number):
        ingest_batch(folder, batch, number, "s", find)
        if number == 2:
            raise RuntimeError("killed")

    query = rows().writeStream.foreachBatch(dies).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination()
    table = Published(spark, folder)
    assert [(c["action"], c["batch"]) for c in table.history()] == [("ingest", 0), ("rejected", 1), ("ingest", 2)]
    ingest_stream(rows(), folder, find, "s", checkpoint).awaitTermination()
    assert [(c["action"], c["batch"]) for c in table.history()] == [("ingest", 0), ("rejected", 1), ("ingest", 2), ("ingest", 3)]
    assert [r.item for r in table.read().orderBy("item").collect()] == list("abdef")
    ingest_stream(rows(), folder, find, "s", checkpoint).awaitTermination()
    assert table.version() == 3
