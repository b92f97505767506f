"""Operators bound to the driver's tables: name -> query, and name -> the same in DuckDB's SQL."""

from curata.queries import annotations, dating, evidence, generated, governance, helpers, identity, metrics, promotion, publication, readiness, records, reports, runs, schema, splits, stats, worksheets
from curata.queries._registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "annotations", "dating", "evidence", "generated", "governance", "helpers", "identity", "metrics", "promotion", "publication", "readiness", "records", "reports", "runs", "schema", "splits", "stats", "worksheets"]
