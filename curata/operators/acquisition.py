"""Acquisition runs as state machines over their logs: what became of each item, and of the batches that a refused member takes back.

An item's state is a fold over its events in order, which streams: a task holds one state. Batches are aggregates over the items' last states.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.plans.storage import ship

# Fixed values: (state, event) -> state; what is not listed is out of turn and changes nothing. The first state is "".
STEPS = {
    ("", "planned"): "planned", ("", "rejected"): "rejected", ("", "present"): "already_present", ("planned", "fetched"): "fetched", ("fetched", "checked"): "acquired", ("planned", "failed"): "failed", ("fetched", "failed"): "failed",
    ("acquired", "failed"): "refused",
}


def fold_states(events: DataFrame, keys: Sequence[str], seq: str, event: str, steps: Mapping[tuple[str, str], str] = STEPS) -> DataFrame:
    """keys, state, n_events, n_ignored of each item after its events in the order of seq (ties by the event). Null keys are keys; a null event is out of turn."""
    ship(events.sparkSession)
    n, table = len(keys), dict(steps)
    rows = events.select(*keys, F.col(event).alias("__event"), F.col(seq).alias("__seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state, total, ignored = "", 0, 0
        for b in batches:
            done = []
            for *k, e in zip(*(b.column(i).to_pylist() for i in range(n + 1)), strict=True):
                if now is not None and k != now:
                    done.append((*now, state, total, ignored))
                    state, total, ignored = "", 0, 0
                now, total = k, total + 1
                if (state, e) in table:
                    state = table[state, e]
                else:
                    ignored += 1
            fields = [b.schema.field(i) for i in range(n)]
            if done:
                yield made(fields, done)
        if now is not None:
            yield made(fields, [(*now, state, total, ignored)])

    def made(fields: list[pa.Field], done: list[tuple]) -> pa.RecordBatch:
        types = [*(f.type for f in fields), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=[*keys, "state", "n_events", "n_ignored"])

    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("state", T.StringType()), T.StructField("n_events", T.LongType()), T.StructField("n_ignored", T.LongType())])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "__seq", "__event").drop("__seq").mapInArrow(run, schema)


def outcomes(items: DataFrame, batch: Sequence[str], back: Sequence[str] = ("refused",)) -> DataFrame:
    """Folded items with ``outcome``: the state, but rolled_back for what was acquired in a batch with a member whose state is in ``back``."""
    spoiled = items.where(F.col("state").isin(*back)).select(*[F.col(b).alias(f"__{b}") for b in batch]).distinct().withColumn("__spoiled", F.lit(True))
    same = F.lit(True)
    for b in batch:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    j = items.join(spoiled, same, "left")
    return j.withColumn("outcome", F.when(F.col("__spoiled") & (F.col("state") == "acquired"), "rolled_back").otherwise(F.col("state"))).drop("__spoiled", *[f"__{b}" for b in batch])


def report(items: DataFrame, batch: Sequence[str], n_bytes: str | None = None) -> DataFrame:
    """Counts of items, and of their bytes, by batch and outcome."""
    total = F.sum(n_bytes) if n_bytes else F.lit(None).cast("long")
    return items.groupBy(*batch, "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("n_ignored").alias("n_ignored"), total.alias("n_bytes"))
