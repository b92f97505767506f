"""What is written under rules: approved plans executed and taken back, lines appended to sealed logs, batches let in whole or not at all. Each is one commit of a published table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.operators.annotations import append_sealed, execute_plan, ledger_heads, plan_digest
from curata.plans.storage import materialize
from curata.plans.versions import Conflict, Published

Find = Callable[[DataFrame], DataFrame]


class Refused(ValueError):
    """What was asked for may not be written; nothing was."""


def check_approval(approver: str | None, approved: str | None, digest: str) -> None:
    if not (approver or "").strip():
        raise Refused("no approver: a person approves every write")
    if approved != digest:
        raise Refused(f"approved is {approved}, but the plan's digest is now {digest}")


def dry_run(table: Published, plan_of: Callable[[DataFrame], DataFrame], item: str) -> str:
    """The digest of the plan on the newest version, to be approved."""
    return plan_digest(plan_of(table.read()), item).first().digest


def promote(table: Published, plan_of: Callable[[DataFrame], DataFrame], item: str, fields: Sequence[str], approver: str | None, approved: str | None) -> dict:
    """Plans anew on the newest version, and publishes the changed records with their changes if the plan is the approved one. Raises Refused, or Conflict if another writer comes first.

    plan_of(records): item, field, before, after. The plan is written once, so that what is digested is what is executed.
    """
    base = table.version()
    records = table.read(base)
    plan = materialize(plan_of(records).select(item, "field", "before", "after"), "plan")
    said = plan_digest(plan, item).first()
    check_approval(approver, approved, said.digest)
    if not said.n:
        raise Refused("the plan changes nothing")
    return _publish(table, execute_plan(records, plan, item, fields), base, plan, {"action": "promote", "approver": approver.strip(), "plan_digest": said.digest, "n_changes": said.n})


def _publish(table: Published, df: DataFrame, base: int, changes: DataFrame, facts: dict) -> dict:
    part = table.write(changes)
    try:
        return table.publish(df, base, facts=facts | {"changes": part, "changes_schema": changes.schema.jsonValue()})
    except Conflict:
        table.drop(part)
        raise


def changes_of(table: Published, version: int) -> DataFrame:
    """The changes that a promotion made; Refused if that version is none, or has been taken back."""
    commits = table.history()
    entry = commits[version] if 0 <= version < len(commits) else {}
    if entry.get("action") != "promote":
        raise Refused(f"version {version} is no promotion")
    if any(c.get("reverts") == version for c in commits):
        raise Refused(f"version {version} has been taken back already")
    return table.spark.read.parquet(f"{table.folder}/{entry['changes']}")


def revert_plan(table: Published, version: int, item: str) -> DataFrame:
    """item, field, before, after: what would put a promotion's fields back."""
    return changes_of(table, version).select(item, "field", F.col("after").alias("before"), F.col("before").alias("after"))


def moved_since(records: DataFrame, plan: DataFrame, item: str, fields: Sequence[str]) -> DataFrame:
    """item, field of a plan's rows whose record is gone or has another value than the plan saw."""
    now = records.select(item, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("now")) for f in fields])).alias("x")).select(item, "x.*", F.lit(True).alias("there"))
    j = plan.join(now, [item, "field"], "left")
    return j.where(F.col("there").isNull() | ~F.col("now").eqNullSafe(F.col("before"))).select(item, "field")


def revert(table: Published, version: int, item: str, fields: Sequence[str], approver: str | None, approved: str | None) -> dict:
    """Puts a promotion's fields back, all or none: refused if one of its records is gone or has changed since."""
    base = table.version()
    records, plan = table.read(base), revert_plan(table, version, item)
    digest = plan_digest(plan, item).first().digest
    check_approval(approver, approved, digest)
    moved = [tuple(r) for r in moved_since(records, plan, item, fields).limit(5).collect()]
    if moved:
        raise Refused(f"changed since version {version}: {moved}")
    return _publish(table, execute_plan(records, plan, item, fields), base, plan, {"action": "revert", "reverts": version, "approver": approver.strip(), "plan_digest": digest})


def append_lines(table: Published, new: DataFrame, log: str, order: Sequence[str], line: str) -> dict:
    """Appends lines behind those of their logs, and the entries that seal them, in one commit; refuses logs that are not as their entries sealed them."""
    base = table.version()
    commits = table.history()
    if base < 0:
        lines, entries = new.limit(0), ledger_heads(new.limit(0), log, order, line)
    else:
        lines, entries = table.read(base), table.spark.read.parquet(f"{table.folder}/{commits[-1]['ledger']}")
    _, sealed = append_sealed(lines, log, order, line, entries, new)
    ledger = table.write(sealed)
    try:
        return table.publish(new, base, append=True, facts={"action": "append", "ledger": ledger})
    except Conflict:
        table.drop(ledger)
        raise


def ingest(table: Published, incoming: DataFrame, find: Find, facts: dict | None = None, note: bool = False) -> tuple[bool, DataFrame]:
    """(accepted, findings): incoming rows are appended if find(all rows) has no finding of severity error, else nothing is. With ``note`` a refusal is an entry in the log as well."""
    base = table.version()
    both = table.read(base).unionByName(incoming) if base >= 0 else incoming
    found = materialize(find(both), "findings")
    n = found.where("severity = 'error'").count()
    if not n:
        table.publish(incoming, base, append=True, facts={"action": "ingest", **(facts or {})})
    elif note:
        table.publish(None, base, facts={"action": "rejected", "n_errors": n, **(facts or {})}, schema=incoming.schema)
    return not n, found
