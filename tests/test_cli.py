"""The command line on files."""

import json

from curata.__main__ import main


def test_command_line(spark, tmp_path, capsys):
    fields = tmp_path / "f.json"
    fields.write_text(json.dumps([{"name": "id", "required": True}, {"name": "n", "kind": "int", "low": 0}, {"name": "kinds", "kind": "array_str", "enum": ["a", "b"]}]))
    rows = tmp_path / "r.jsonl"
    rows.write_text('{"id":"x1","n":3,"kinds":["a","b"]}\n{"id":"x2","n":-1}\n')
    assert main(["list"]) == 0 and "dup_findings" in capsys.readouterr().out
    assert main(["validate", str(rows), "--fields", str(fields)]) == 1
    assert "errors 1" in capsys.readouterr().out
    assert main(["convert", str(rows), f"{tmp_path}/csv.csv", "--fields", str(fields)]) == 0
    assert main(["convert", f"{tmp_path}/csv.csv", f"{tmp_path}/back", "--fields", str(fields)]) == 0
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/back").collect()) == ['{"id":"x1","n":3,"kinds":["a","b"]}', '{"id":"x2","n":-1}']
    assert main(["run", "gates_report", "/root/testdata/sf0.001", "--out", f"{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    assert main(["explain", "class_weights", "/root/testdata/sf0.001"]) == 0
