"""Shared plumbing: how a per-text function runs over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from curata.plans.storage import materialize, shared_dir, ship

__all__ = ["SLICE", "fresh", "map_texts", "materialize", "read", "shared_dir", "ship"]

#: Rows turned into Python objects at a time; bounds a worker's memory, never what is processed.
SLICE = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[..., tuple]],
    schema: str | T.StructType,
    keep: Sequence[str],
    inputs: Sequence[str] = ("text",),
) -> DataFrame:
    """One output row for each input row: the columns ``keep``, then what the function made by ``make()`` returns for ``inputs``.

    The function is made once for each task. Only the named columns are read, so other columns of any name do no harm.
    ``schema`` names the function's columns; a column both kept and computed is not allowed.
    """
    ship(docs.sparkSession)
    made = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    frame = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *inputs])])
    kept_fields = [frame.schema[c] for c in keep]
    out = T.StructType(kept_fields + list(made.fields))
    arrow = to_arrow_schema(out)
    types = [arrow.field(len(kept_fields) + i).type for i in range(len(made.fields))]
    keep, inputs = list(keep), list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = [f(*x) for x in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in inputs), strict=True)]
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                cols += [pa.array(list(x), type=t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return frame.mapInArrow(run, out)
