"""Command line: list, run and explain queries; validate and convert record files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from curata.operators import rules
from curata.operators.rules import Field
from curata.queries import QUERIES
from curata.sources import records


def fields_of(path: str) -> list[Field]:
    """Fields from a JSON list of objects with the names of Field's own."""
    import json

    with open(path, encoding="utf-8") as f:
        return [Field(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items()}) for x in json.load(f)]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="curata", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    for name in ("run", "explain"):
        q = sub.add_parser(name)
        q.add_argument("query", choices=sorted(QUERIES))
        q.add_argument("data", help="a folder of Parquet tables")
        if name == "run":
            q.add_argument("--out", help="Parquet folder to write; without it the first rows are shown")
    v = sub.add_parser("validate")
    v.add_argument("records")
    v.add_argument("--fields", help="JSON list of fields")
    v.add_argument("--export", action="store_true")
    v.add_argument("--strict", action="store_true")
    c = sub.add_parser("convert")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--fields", required=True)
    a = p.parse_args(argv)
    if a.what == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = SparkSession.builder.appName("curata").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.what == "explain":
        QUERIES[a.query](spark, a.data).explain("formatted")
    elif a.what == "run":
        df = QUERIES[a.query](spark, a.data)
        df.write.parquet(a.out) if a.out else df.show(50, truncate=False)
    elif a.what == "validate":
        raw = records.load_records(spark, a.records).withColumn("i", F.monotonically_increasing_id())
        found = rules.record_findings(raw, "i", "raw", fields_of(a.fields) if a.fields else (), a.export)
        rules.sort_findings(found).show(200, truncate=False)
        row = rules.verdict(found, a.strict).first()
        print(f"errors {row.n_errors}, warnings {row.n_warnings}: {'ok' if row.ok else 'not ok'}")
        return int(not row.ok)
    else:
        fields = fields_of(a.fields)
        if a.source.endswith(".csv"):
            records.read_csv(spark, a.source).select(records.from_cells(fields).alias("value")).write.text(a.target)
        else:
            df = records.load_records(spark, a.source).withColumn("v", F.parse_json("raw"))
            records.write_csv(df.select(*records.to_cells(F.col("raw"), F.col("v"), fields)), a.target, [f.name for f in fields])
    return 0


if __name__ == "__main__":
    sys.exit(main())
