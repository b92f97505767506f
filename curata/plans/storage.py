"""Where intermediate tables go: the folder that the cluster names in spark.checkpoint.dir, reached by driver and executors alike."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import curata

#: A side of a join is broadcast up to so many rows, by a counted number; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Rows of a few numbers that make a file worth its while.
FILE_ROWS = 100_000
BATCH_KEY, SPARK_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20), "16m"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each Spark context, so that they need no installation of it.

    Also lowers the session's Arrow batches from Spark's 64 MB to BATCH_BYTES, unless they are set otherwise: rows here hold whole texts.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH_KEY, SPARK_BATCH).rstrip("b") == SPARK_BATCH:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    if not getattr(sc, "_curata_shipped", False):
        root = Path(curata.__file__).parent
        target = Path(tempfile.mkdtemp(prefix="curata-")) / "curata.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(target))
        sc._curata_shipped = True


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local master gets a temporary one; a cluster is refused, as its executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        root = "file://" + tempfile.mkdtemp(prefix="curata-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/curata/{tag}-{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault("_curata_folders", []).append(path)
    return path


def discard(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this session's context has made so far; how many. For the end of a job: results that still read them are lost."""
    made = spark.sparkContext.__dict__.pop("_curata_folders", [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in made:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    return len(made)


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet and reads it back: lineage ends there, and a lost executor costs its tasks alone.

    rows, an upper bound of what df holds, keeps small tables of narrow rows from being a file for each shuffle partition.
    """
    path = shared_dir(df.sparkSession, tag)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it counts at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
