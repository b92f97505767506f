"""Functions of the user by name and kind, and grids of perturbations over rows.

An engine takes a column of texts and gives a row of its kind's columns for each; of a kind without an engine every row says that there is none, so that what depends on one reports it and goes on.
A perturbation changes a text by a seed that follows from its own name and the row's id, so a grid is the same on every run and layout.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from curata.plans.storage import ship

#: Texts to rows of the kind's columns, in order.
Run = Callable[[list[str | None]], Sequence[tuple]]
NONE = "no_engine"
# The kinds and what their engines say.
KINDS = {
    "classifier": "label string, score double", "detector": "boxes array<struct<x:double,y:double,w:double,h:double,score:double>>", "transcriber": "status string, text string, score double",
}


@dataclass(frozen=True)
class Engine:
    """make is called once a task, where a model is loaded, and gives the function."""

    name: str
    kind: str
    version: str
    make: Callable[[], Run]


@dataclass
class Registry:
    kinds: Mapping[str, str] = field(default_factory=lambda: dict(KINDS))
    engines: dict[tuple[str, str], Engine] = field(default_factory=dict)

    def add(self, engine: Engine) -> None:
        if engine.kind not in self.kinds:
            raise ValueError(f"no kind {engine.kind}: {', '.join(self.kinds)}")
        if (engine.kind, engine.name) in self.engines:
            raise ValueError(f"{engine.kind} {engine.name} is there already")
        self.engines[engine.kind, engine.name] = engine

    def schema(self, kind: str) -> T.StructType:
        return T._parse_datatype_string(f"engine string, version string, {self.kinds[kind]}")

    def apply(self, df: DataFrame, kind: str, text: str, name: str | None = None) -> DataFrame:
        """df with engine, version and the kind's columns. Without a name: the kind's only engine, or none, which is engine 'no_engine' and nulls."""
        if kind not in self.kinds:
            raise ValueError(f"no kind {kind}: {', '.join(self.kinds)}")
        there = [e for (k, n), e in self.engines.items() if k == kind and name in (None, n)]
        if name is not None and not there:
            raise ValueError(f"no {kind} {name}")
        if len(there) > 1:
            raise ValueError(f"several engines of kind {kind}: name one of {', '.join(e.name for e in there)}")
        made = self.schema(kind)
        if clash := set(made.names) & set(df.columns):
            raise ValueError(f"columns are there already: {', '.join(sorted(clash))}")
        if not there:
            return df.select("*", F.lit(NONE).alias("engine"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in made.fields[1:]])
        ship(df.sparkSession)
        engine, at, arrow, n = there[0], df.columns.index(text), to_arrow_schema(made), len(made)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            said = engine.make()
            for b in batches:
                rows = list(said(b.column(at).to_pylist()))
                if len(rows) != b.num_rows or any(len(r) != n - 2 for r in rows):
                    raise ValueError(f"{engine.name} gave {len(rows)} rows for {b.num_rows}, or rows of other columns")
                cols = [list(c) for c in zip(*((engine.name, engine.version, *r) for r in rows), strict=True)] or [[]] * n
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True))], names=[*b.schema.names, *made.names])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, *made.fields]))


@dataclass(frozen=True)
class Perturbation:
    """change is None for the text as it is, else takes a text and a seed."""

    name: str
    family: str
    severity: str
    change: Callable[[str, int], str] | None = None


def seed(name: str, item: object) -> int:
    return int.from_bytes(hashlib.sha256(f"{name}:{item}".encode()).digest()[:8], "big")


def no_vowels(text: str, _: int) -> str:
    return text.translate(dict.fromkeys(map(ord, "aeiouAEIOU")))


def first_half(text: str, _: int) -> str:
    return text[: len(text) // 2]


def dropped(share: float) -> Callable[[str, int], str]:
    """Each character goes with this probability."""
    return lambda text, s: (lambda r: "".join(c for c in text if r.random() >= share))(random.Random(s))


CLEAN = Perturbation("clean", "none", "none")
TEXTUAL = (CLEAN, Perturbation("no_vowels", "loss", "moderate", no_vowels), Perturbation("first_half", "crop", "strong", first_half), Perturbation("dropped_5", "noise", "mild", dropped(0.05)), Perturbation("dropped_20", "noise", "strong", dropped(0.2)))


def grid(df: DataFrame, item: str, text: str, perturbations: Sequence[Perturbation] = TEXTUAL) -> DataFrame:
    """df once for each perturbation, with its name, family and severity and the changed text. A null text stays null. Rows are changed one at a time; nothing is held but a batch."""
    ship(df.sparkSession)
    if len({p.name for p in perturbations}) < len(perturbations):
        raise ValueError("two perturbations of one name")
    at_item, at_text, every = df.columns.index(item), df.columns.index(text), list(perturbations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, texts = b.column(at_item).to_pylist(), b.column(at_text)
            for p in every:
                new = texts if p.change is None else pa.array([None if t is None else p.change(t, seed(p.name, i)) for i, t in zip(items, texts.to_pylist(), strict=True)], texts.type)
                cols = [new if k == at_text else c for k, c in enumerate(b.columns)]
                said = [pa.array([x] * b.num_rows, pa.string()) for x in (p.name, p.family, p.severity)]
                yield pa.RecordBatch.from_arrays([*cols, *said], names=[*b.schema.names, "perturbation", "family", "severity"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, T.StringType()) for n in ("perturbation", "family", "severity"))]))


def robustness(said: DataFrame, right: str) -> DataFrame:
    """perturbation, family, severity, n, n_right, accuracy, drop_from_clean of a grid's rows with a column that says whether the answer is right; a null counts as wrong."""
    g = said.groupBy("perturbation", "family", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(right)).alias("n_right"))
    g = g.withColumn("accuracy", F.try_divide(F.col("n_right").cast("double"), F.col("n").cast("double")))
    clean = g.where(F.col("perturbation") == CLEAN.name).agg(F.max("accuracy").alias("__clean"))  # one row
    return g.crossJoin(F.broadcast(clean)).withColumn("drop_from_clean", F.col("__clean") - F.col("accuracy")).drop("__clean")
