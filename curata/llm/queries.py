"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from curata.llm import bpe, centroids, chat, dedup, licenses, media, mixing, pii, quality, secrets, tokens, topk, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_media_columns": media.op2_media_columns,
    "op3_mixture": mixing.op3_mixture,
    "op4_chat_perspectives": chat.op4_chat_perspectives,
    "op5_minhash_dedup": dedup.op5_minhash_dedup,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_pii": pii.op7_pii,
    "op8_secrets": secrets.op8_secrets,
    "op9_bpe": bpe.op9_bpe,
    "op10_top_k": topk.op10_top_k,
    "op11_centroids": centroids.op11_centroids,
    "op12_token_counts": tokens.op12_token_counts,
    "op13_whitening": whitening.op13_whitening,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op3_mixture": mixing.ORACLE,
    "op4_chat_perspectives": chat.ORACLE,
    "op10_top_k": topk.ORACLE,
    "op11_centroids": centroids.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
