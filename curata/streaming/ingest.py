"""Batches of a stream let in whole or not at all, each once.

The log of the published table says which batches have been decided, accepted or refused, so a batch that Spark gives again after a crash, whether it died before the commit or between the commit and its own
checkpoint, changes nothing the second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from curata.operators.publication import Find, ingest
from curata.plans.versions import Published


def ingest_batch(folder: str, batch: DataFrame, number: int, name: str, find: Find) -> bool | None:
    """Whether the batch was accepted; None if it had been decided before."""
    table = Published(batch.sparkSession, folder)
    if any(c.get("stream") == name and c["batch"] >= number for c in table.history()):
        return None
    return ingest(table, batch, find, {"stream": name, "batch": number}, note=True)[0]


def ingest_stream(rows: DataFrame, folder: str, find: Find, name: str, checkpoint: str) -> StreamingQuery:
    """Lets in what has arrived, batch by batch, and stops. ``name`` tells streams into one table apart; one checkpoint belongs to one name."""

    def each(batch: DataFrame, number: int) -> None:
        ingest_batch(folder, batch, number, name, find)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
