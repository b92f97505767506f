"""Append-only annotation logs: what is current, who agrees, what an item's status is, hash chains, and plans that change records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.operators.identity import fingerprint

GENESIS = "0" * 64


def current(log: DataFrame, id_col: str, supersedes: str) -> DataFrame:
    """The rows that no other row supersedes."""
    gone = log.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(id_col)).distinct()
    return log.join(gone, id_col, "left_anti")


def supersession_problems(log: DataFrame, id_col: str, supersedes: str, item: str, author: str) -> DataFrame:
    """N11 findings: superseded twice, unknown target, another item, another author."""
    later = log.where(F.col(supersedes).isNotNull())
    twice = later.groupBy(supersedes).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(supersedes).alias("id"), F.lit("superseded_twice").alias("problem"))
    target = log.select(F.col(id_col).alias("__id"), F.col(item).alias("__item"), F.col(author).alias("__author"))
    met = later.join(target, F.col(supersedes) == F.col("__id"), "left")
    what = F.when(F.col("__id").isNull(), "unknown_target").when(~F.col(item).eqNullSafe(F.col("__item")), "other_item").when(~F.col(author).eqNullSafe(F.col("__author")), "other_author")
    return twice.unionByName(met.select(F.col(id_col).alias("id"), what.alias("problem")).where("problem IS NOT NULL"))


def pair_raters(log: DataFrame, item: str, author: str, a: str, b: str, value: str) -> DataFrame:
    """item, value_a, value_b, skipped: null where each rater has one current row, else why the item is left out."""
    one = lambda who, name: log.where(F.col(author) == who).groupBy(item).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.first(value).alias(f"value_{name}"))
    j = log.select(item).distinct().join(one(a, "a"), item, "left").join(one(b, "b"), item, "left").fillna(0, ["n_a", "n_b"])
    none = F.concat_ws(" or ", F.when(F.col("n_a") == 0, F.lit(a)), F.when(F.col("n_b") == 0, F.lit(b)))
    why = F.when(none != "", F.concat(F.lit("no current row by "), none)).when((F.col("n_a") > 1) | (F.col("n_b") > 1), "more than one current row for a rater")
    ok = why.isNull()
    return j.select(item, F.when(ok, F.col("value_a")).alias("value_a"), F.when(ok, F.col("value_b")).alias("value_b"), why.alias("skipped"))


def disagreements(log: DataFrame, item: str, author: str, order: str, fields: Sequence[str], unassessed: Sequence[str] = ("unknown", "not_assessed")) -> DataFrame:
    """item, field, n_values, values: fields in which the authors' last values differ; null and ``unassessed`` values agree with any. Long form, values by author in a map-side combined aggregate."""
    last = log.groupBy(item, author).agg(*[F.max_by(f, order).alias(f) for f in fields])
    long = last.select(item, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(item, "x.*")
    values = F.array_sort(F.collect_set(F.when(~F.col("value").isin(*unassessed), F.col("value"))))
    return long.groupBy(item, "field").agg(values.alias("v")).where(F.size("v") > 1).select(item, "field", F.size("v").alias("n_values"), F.array_join("v", "|").alias("values"))


def resolve(log: DataFrame, item: str, kind: str, state: str, label: str, adjudication: str, created: str, id_col: str, resolves: str) -> DataFrame:
    """item, status, label, ground_truth: adjudicated or (if it leaves rows out) disputed; disputed; expert label; provisional; project disagreement; unannotated.

    kind: ai_prediction, expert_annotation or other; adjudication: whether a row is one; resolves: the ids it settles.
    """
    human = F.col(kind) != "ai_prediction"
    expert = (F.col(kind) == "expert_annotation") & (F.col(state) == "expert_reviewed")
    settled = expert & F.coalesce(F.col(adjudication), F.lit(False))
    last = F.max(F.when(settled, F.struct(F.col(created).alias("c"), F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(resolves).alias("resolves"))))
    heads = log.groupBy(item).agg(last.alias("__adj"))
    j = log.join(heads, item)
    uncovered = human & F.col("__adj").isNotNull() & (F.col(id_col) != F.col("__adj.id")) & ~F.coalesce(F.array_contains("__adj.resolves", F.col(id_col)), F.lit(False))
    g = j.groupBy(item).agg(
        F.count_if(human).alias("n_human"), F.count_if(uncovered).alias("n_uncovered"), F.count_if(human & (F.col(state) == "disputed")).alias("n_disputed"), F.count_if(expert).alias("n_expert"),
        F.min(F.when(expert, F.col(label))).alias("e0"), F.max(F.when(expert, F.col(label))).alias("e1"), F.min(F.when(human, F.col(label))).alias("h0"), F.max(F.when(human, F.col(label))).alias("h1"),
        F.max(F.struct(F.col("__adj.id").alias("id"), F.col("__adj.label").alias("label"))).alias("adj"),
    )
    known = lambda c: F.when(c != "unknown", c)
    status = (
        F.when(F.col("n_human") == 0, "unannotated").when(F.col("adj.id").isNotNull() & (F.col("n_uncovered") > 0), "disputed").when(F.col("adj.id").isNotNull(), "adjudicated")
        .when(F.col("n_disputed") > 0, "disputed").when((F.col("n_expert") > 0) & (F.col("e0") == F.col("e1")) & (F.col("e0") != "unknown"), "expert_label").when(F.col("n_expert") > 0, "disputed")
        .when(F.col("h0") == F.col("h1"), "provisional").otherwise("project_disagreement")
    )
    out = g.withColumn("status", status)
    value = F.when(F.col("status") == "adjudicated", known(F.col("adj.label"))).when(F.col("status") == "expert_label", F.col("e0")).when(F.col("status") == "provisional", known(F.col("h0")))
    return out.select(item, "status", value.alias("label"), (F.col("status").isin("adjudicated", "expert_label") & value.isNotNull()).alias("ground_truth"))


def ledger_heads(df: DataFrame, log: str, order: Sequence[str], line: str) -> DataFrame:
    """log, n_lines, head for each log: each link is the digest of the last head and the line's digest, from GENESIS on. A null line counts as an empty one, a null log is a log.

    A chain is sequential by its nature: lines' digests, not lines, are sorted within their logs and streamed, so a task holds one head, however long a log is.
    """
    rows = df.select(F.col(log), *[F.col(c).alias(f"__{i}") for i, c in enumerate(order)], F.sha2(F.coalesce(F.col(line).cast("string"), F.lit("")), 256).alias("__digest"))
    keys = [f"__{i}" for i in range(len(order))]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, head = None, 0, GENESIS
        for b in batches:
            done: list[tuple[object, int, str]] = []
            for k, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n and k != now:
                    done.append((now, n, head))
                    n, head = 0, GENESIS
                now, n, head = k, n + 1, hashlib.sha256((head + digest).encode()).hexdigest()
            if done:
                yield made(b.schema.field(0), done)
            field = b.schema.field(0)
        if n:
            yield made(field, [(now, n, head)])

    def made(field: pa.Field, done: list[tuple[object, int, str]]) -> pa.RecordBatch:
        of, counts, heads = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(of, field.type), pa.array(counts, pa.int32()), pa.array(heads)], names=[log, "n_lines", "head"])

    sorted_rows = rows.repartition(log).sortWithinPartitions(log, *keys, "__digest").select(log, "__digest")
    return sorted_rows.mapInArrow(link, T.StructType([df.select(log).schema[0], T.StructField("n_lines", T.IntegerType()), T.StructField("head", T.StringType())]))


def verify_ledger(df: DataFrame, log: str, order: Sequence[str], line: str, entries: DataFrame) -> DataFrame:
    """log, status: EMPTY, INTACT or TAMPERED_OR_UNSEALED, against entries (log, n_lines, head)."""
    now = ledger_heads(df, log, order, line)
    sealed = entries.select(F.col(log), F.col("n_lines").alias("sealed_n"), F.col("head").alias("sealed_head"))
    status = F.when(F.coalesce("n_lines", F.lit(0)) + F.coalesce("sealed_n", F.lit(0)) == 0, "EMPTY").when((F.col("n_lines") == F.col("sealed_n")) & (F.col("head") == F.col("sealed_head")), "INTACT").otherwise("TAMPERED_OR_UNSEALED")
    return now.join(sealed, log, "full_outer").select(log, "n_lines", "sealed_n", status.alias("status"))


def append_sealed(df: DataFrame, log: str, order: Sequence[str], line: str, entries: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all lines, entries that seal them) with the new lines behind those of their logs; raises, naming a few, if a log is not as its entry sealed it, or a new line holds a line break.

    Nothing is written here: both tables are to be written together.
    """
    broken = [r[log] for r in verify_ledger(df, log, order, line, entries).where("status NOT IN ('INTACT', 'EMPTY')").select(log).limit(5).collect()]
    if broken:
        raise ValueError(f"logs that are not as they were sealed: {broken}")
    if not new.where(F.col(line).contains("\n")).isEmpty():
        raise ValueError("a line holds a line break")
    both = df.unionByName(new)
    return both, ledger_heads(both, log, order, line)


def promotion_plan(votes: DataFrame, item: str, fields: Sequence[str], records: DataFrame) -> DataFrame:
    """item, field, before, after for each field on which all votes agree (null votes do not count) and the record differs."""
    g = votes.groupBy(item).agg(*[F.struct(F.count_distinct(f).alias("n"), F.min(f).cast("string").alias("v")).alias(f"__{f}") for f in fields])
    j = g.join(records.select(item, *fields), item)
    long = j.select(item, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("before"), F.when(F.col(f"__{f}.n") == 1, F.col(f"__{f}.v")).when(F.col(f"__{f}.n") > 1, F.lit("disputed")).alias("after")) for f in fields])).alias("x"))
    return long.select(item, "x.*").where("after IS NOT NULL AND NOT (before <=> after)")


def plan_digest(plan: DataFrame, item: str) -> DataFrame:
    """n, digest: one digest of a plan, whatever its rows' order; what is executed must have the digest that was approved. Rows are digested by bucket and level, so none are gathered."""
    row = F.to_json(F.struct(item, "field", "before", "after"), {"ignoreNullFields": "false"})
    return fingerprint(plan, item, row, "plan\n").select(F.col("n_rows").alias("n"), F.col("fingerprint").alias("digest"))


def execute_plan(records: DataFrame, plan: DataFrame, item: str, fields: Sequence[str], revert: bool = False) -> DataFrame:
    """records with the plan's values; with revert, those before. A field is set only where it still has the value the plan saw, else the plan's row is left undone."""
    src, dst = ("after", "before") if revert else ("before", "after")
    wide = plan.groupBy(item).agg(*[F.max(F.when(F.col("field") == f, F.struct(F.lit(1).alias("on"), F.col(src).alias("src"), F.col(dst).alias("dst")))).alias(f"__{f}") for f in fields])
    j = records.join(wide, item, "left")
    for f in fields:
        go = F.col(f"__{f}.on").isNotNull() & F.col(f).cast("string").eqNullSafe(F.col(f"__{f}.src"))
        j = j.withColumn(f, F.when(go, F.col(f"__{f}.dst").cast(records.schema[f].dataType)).otherwise(F.col(f)))
    return j.select(*records.columns)


def field_diff(before: DataFrame, after: DataFrame, item: str, fields: Sequence[str]) -> DataFrame:
    """item and the sorted names of fields that differ (null-safe); items in both tables alone."""
    b = after.select(item, *[F.col(f).alias(f"__{f}") for f in fields])
    changed = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return before.join(b, item).select(item, F.array_join(F.array_sort(changed), ",").alias("changed")).where("changed <> ''")


def upsert(registry: DataFrame, incoming: DataFrame, id_col: str, seq: str) -> DataFrame:
    """Last write wins by seq, one row an id."""
    both = registry.unionByName(incoming, allowMissingColumns=True)
    rest = [c for c in both.columns if c != id_col]
    return both.groupBy(id_col).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(id_col, "r.*")
