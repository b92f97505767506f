"""The corpus pipeline: quality, near-duplicates, personal data, mixture, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curata.llm import _base, bpe, dedup, mixing, pii, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the compression classifier rejects; it learns from the labelled rows among docs."""
    docs = docs.select(*COLUMNS)
    model = quality.fit(quality.training_sample(docs, _base.read(spark, sf_dir, "labels")))
    return quality.keep_good(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document, that of the smallest id, of each group of near-duplicates on five-word shingles at 0.8."""
    return dedup.drop_near_duplicates(docs.select(*COLUMNS), size=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in angle brackets in the place of personal data; n_chars follows."""
    return pii.redact_pii(docs.select(*COLUMNS))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: each document as often as it is taken."""
    return mixing.apply_mix(docs.select(*COLUMNS))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document of the mix: its ids, their number and digest, and the digest of the text decoded from them."""
    tokens = bpe.encode_texts(docs.select(*COLUMNS), bpe.default_path(), with_ids=True)
    return tokens.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("pii", pii_stage),
    ("mixture", mixture_stage),
    ("bpe", tokens_stage),
]

#: The classifier, the near-duplicates and the tokenizer have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each but the last is written in the shared folder and read again."""
    docs = _base.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _base.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
