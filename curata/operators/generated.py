"""Data sets made from nothing but names and a seed, and the lock that says what they are.

Every value is drawn from a digest of seed, artifact, view and what it is for (functions.phrases.draw), so a record depends on its own names alone: any part can be made anew, by any task, on any layout, and be compared.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.phrases import draw
from curata.operators.identity import canonical, fingerprint

VERSION = "1.0.0"
# What marks a record as made up.
TYPE, MARKER, SOURCE = "synthetic", "SYNTHETIC - NOT ARCHAEOLOGICAL EVIDENCE", "synthetic_generator"
#: The parts of a lock that must hold for a table to be the one that was locked.
LOCKED = ("config_digest", "n_artifacts", "n_records", "by_class", "records_fingerprint", "parameters_fingerprint", "split_digest")


@dataclass(frozen=True)
class Config:
    """Classes, each artifact in one; how many views an artifact has at most; of how many glyphs marks are made."""

    seed: int
    classes: Sequence[str]
    views: int = 4
    glyphs: int = 24
    longest: int = 8

    @property
    def text(self) -> str:
        return json.dumps({"seed": self.seed, "classes": list(self.classes), "views": self.views, "glyphs": self.glyphs, "longest": self.longest, "version": VERSION}, sort_keys=True)


def generate(artifacts: DataFrame, artifact: str, config: Config, classes: Mapping[str, str] | None = None) -> DataFrame:
    """A record for each view of each artifact (one row a name): record, artifact, view, label, glyphs, width, height, tilt, path, parameters_digest, digest, and what marks it as made up.

    digest stands for the bytes that a renderer would make of the parameters. classes: presence words by class, as ``present``.
    """
    a, seed = F.col(artifact).cast("string"), F.lit(config.seed)
    at = lambda *place: draw(seed, a, *[p if isinstance(p, Column) else F.lit(p) for p in place])
    one = lambda what, n: at(what) % n
    labels = F.array(*map(F.lit, config.classes))
    rows = artifacts.select(
        a.alias("artifact"), F.element_at(labels, (one("class", len(config.classes)) + 1).cast("int")).alias("label"), (one("views", config.views) + 1).alias("n"), (one("length", config.longest) + 1).cast("int").alias("m"),
        a.alias("__a"),
    )
    a = F.col("__a")
    rows = rows.withColumn("glyphs", F.transform(F.sequence(F.lit(1), F.col("m")), lambda i: F.concat(F.lit("G"), F.lpad((at("glyph", i) % config.glyphs).cast("string"), 2, "0"))))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("view"))
    of = lambda what, n, least: (at("view", F.col("view"), what) % n + least).cast("int").alias(what)
    rows = rows.select("artifact", "label", "glyphs", F.col("view").cast("int").alias("view"), of("width", 200, 300), of("height", 150, 200), of("tilt", 41, -20))
    record = F.concat(F.lit("SYN-"), F.col("artifact"), F.lit("-V"), F.col("view").cast("string"))
    rows = rows.select(record.alias("record"), "*", F.concat(F.lit("images/"), record, F.lit(".png")).alias("path"))
    parameters = F.sha2(F.concat_ws("\x1f", "artifact", "label", F.array_join("glyphs", " "), F.col("width").cast("string"), F.col("height").cast("string"), F.col("tilt").cast("string")), 256)
    present = F.try_element_at(F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]), F.col("label")) if classes else F.lit(None).cast("string")
    rows = rows.select("*", parameters.alias("parameters_digest"), present.alias("present"), F.lit(TYPE).alias("dataset_type"), F.lit(MARKER).alias("marker"), F.lit(SOURCE).alias("source"), F.lit(VERSION).alias("version"), F.lit(config.seed).alias("seed"))
    return rows.withColumn("digest", F.sha2(F.concat_ws("\x1f", F.lit(VERSION), F.col("record"), F.col("parameters_digest")), 256))


def lock(records: DataFrame, config: Config, split_digest: str | None = None) -> DataFrame:
    """One row of LOCKED: what a table of records is, whatever its order and layout; no time and no machine is in it."""
    by = records.groupBy("label").agg(F.count_distinct("artifact").alias("a"), F.count(F.lit(1)).alias("r"))
    counts = by.agg(F.sum("a").alias("n_artifacts"), F.to_json(F.array_sort(F.collect_list(F.struct("label", F.col("a").alias("artifacts"), F.col("r").alias("records"))))).alias("by_class"))  # a row a class
    whole = fingerprint(records, "record", canonical(records.columns), "records\n").select("n_rows", F.col("fingerprint").alias("records_fingerprint"))
    made = fingerprint(records, "record", F.concat_ws("\x1f", "record", "digest", "parameters_digest"), "parameters\n").select(F.col("fingerprint").alias("parameters_fingerprint"))
    one = counts.crossJoin(whole).crossJoin(made)  # one row each
    return one.select(F.sha2(F.lit(config.text), 256).alias("config_digest"), F.coalesce("n_artifacts", F.lit(0)).alias("n_artifacts"), F.col("n_rows").alias("n_records"), "by_class", "records_fingerprint", "parameters_fingerprint", F.lit(split_digest).cast("string").alias("split_digest"))


def lock_differences(locked: DataFrame, now: DataFrame) -> DataFrame:
    """name, locked, found: the parts of two locks that differ; all of them where there is no lock."""
    long = lambda df, c: df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("string").alias(c)) for k in LOCKED])).alias("x")).select("x.*")
    return long(now, "found").join(long(locked, "locked").withColumn("__there", F.lit(True)), "name", "left").where("__there IS NULL OR NOT (locked <=> found)").select("name", "locked", "found")


def not_reproduced(records: DataFrame, artifacts: DataFrame, artifact: str, config: Config, classes: Mapping[str, str] | None = None) -> DataFrame:
    """record, problem: records of these artifacts that are not what they would be if they were made anew: changed, missing, or never made."""
    anew = generate(artifacts, artifact, config, classes).select("record", F.col("digest").alias("__d"), F.col("parameters_digest").alias("__p"), F.lit(True).alias("__anew"))
    kept = records.join(artifacts.select(F.col(artifact).cast("string").alias("artifact")).distinct(), "artifact", "left_semi").select("record", "digest", "parameters_digest", F.lit(True).alias("__kept"))
    j = anew.join(kept, "record", "full_outer")
    same = F.col("digest").eqNullSafe(F.col("__d")) & F.col("parameters_digest").eqNullSafe(F.col("__p"))
    return j.select("record", F.when(F.col("__kept").isNull(), "missing").when(F.col("__anew").isNull(), "never made").when(~same, "changed").alias("problem")).where("problem IS NOT NULL")
