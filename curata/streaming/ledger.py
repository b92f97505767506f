"""An append-only log as a stream: an extension, since the batch operators already give what a log holds at any time.

Rows arrive as files; each micro-batch is appended to a table with its digest a row. Windows over event time with a watermark, and one
stateful count a key, show what arrives late and who appends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def append(log: DataFrame, path: str, checkpoint: str, line: str) -> StreamingQuery:
    """Appends the lines with their digests, each exactly once, and stops when all that has arrived is written."""
    return log.withColumn("line_sha256", F.sha2(F.col(line), 256)).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key; the same on a table as on a stream, where rows later than the watermark are left out."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def session_counts(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")
