"""Files in and out, manifests, and the streaming extension against the batch result."""

import json

import pytest
from pyspark.sql import functions as F

from curata.operators.rules import Field
from curata.sources import records as R
from curata.streaming import ledger

FIELDS = [Field("id", required=True), Field("n", "int", nullable=True), Field("kinds", "array_str", enum=("a", "b")), Field("notes", "array_str"), Field("regions", "array_obj"), Field("text")]
RECORDS = [{"id": "r1", "n": 3, "kinds": ["a", "b"], "notes": ["x; y", "z"], "regions": [{"x": 1}], "text": 'é, "q"; வ\nb'}, {"id": "r2", "n": None, "kinds": [], "notes": [], "regions": []}, {"id": "r3"}]


def test_cells_round_trip_through_csv(spark, tmp_path):
    df = spark.createDataFrame([(json.dumps(r),) for r in RECORDS], "raw string").withColumn("v", F.parse_json("raw"))
    R.write_csv(df.select(*R.to_cells(F.col("raw"), F.col("v"), FIELDS)), f"{tmp_path}/c", [f.name for f in FIELDS])
    back = R.read_csv(spark, f"{tmp_path}/c").select(R.from_cells(FIELDS).alias("raw")).collect()
    assert sorted((json.loads(r.raw) for r in back), key=lambda r: r["id"]) == RECORDS
    bad = spark.createDataFrame([("r", "x", "", "", "", "")], "id string, n string, kinds string, notes string, regions string, text string")
    with pytest.raises(Exception, match="not int"):
        bad.select(R.from_cells(FIELDS)).collect()


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"b":1,"a":2}\n\n{"b":3}\n')
    assert R.load_records(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "b.jsonl").write_text('{"b":1}\nnope\n')
    with pytest.raises(Exception, match="b.jsonl: no JSON: nope"):
        R.read_jsonl(spark, str(tmp_path / "b.jsonl")).collect()
    assert [r.ok for r in R.read_jsonl(spark, str(tmp_path / "b.jsonl"), fail=False).collect()] == [True, False]
    (tmp_path / "c.json").write_text('[{"a":1},{"a":2}]')
    assert sorted(r.raw for r in R.load_records(spark, str(tmp_path / "c.json")).collect()) == ['{"a":1}', '{"a":2}']
    R.write_jsonl(spark.createDataFrame([(1, 2, 3)], "z int, b int, a int"), f"{tmp_path}/out", ["b"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ['{"b":2,"a":3,"z":1}']
    with pytest.raises(ValueError, match="not in the schema"):
        R.write_csv(spark.createDataFrame([(1, 2)], "a int, b int"), f"{tmp_path}/x", ["a"])


def test_manifest_refuses_changes(spark, tmp_path):
    a = spark.createDataFrame([("g1", "train"), ("g2", "test")], "g string, p string")
    R.save_manifest(a, "g", "p", f"{tmp_path}/m")
    assert sorted(R.load_manifest(spark, f"{tmp_path}/m", "g", "p").collect()) == sorted(a.collect())
    a.withColumn("p", F.lit("train")).write.mode("overwrite").parquet(f"{tmp_path}/m/assignments")
    with pytest.raises(ValueError, match="not those"):
        R.load_manifest(spark, f"{tmp_path}/m", "g", "p")


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.JPG").write_bytes(b"1")
    (tmp_path / "y.txt").write_bytes(b"2")
    assert [r.suffix for r in R.scan_files(spark, str(tmp_path), [".jpg"]).collect()] == [".jpg"]
    assert R.scan_files(spark, str(tmp_path)).count() == 2


def test_stream_is_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps({"ts": f"2024-01-01T{h:02d}:10:00Z", "kind": "ab"[h % 2], "line": f"l{i}{h}"}) + "\n" for h in range(i, 20, 3)))
    schema = "ts timestamp, kind string, line string"
    stream = ledger.read_log(spark, f"{tmp_path}/in", schema)
    for _ in range(2):  # a second run appends nothing
        ledger.append(stream, f"{tmp_path}/out", f"{tmp_path}/cp", "line").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 20 and out.where(F.sha2("line", 256) != F.col("line_sha256")).count() == 0
    q = ledger.windowed_counts(stream, "ts", "kind", late="30 days").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("w").collect()) == sorted(ledger.windowed_counts(spark.read.schema(schema).json(f"{tmp_path}/in"), "ts", "kind").collect())
