"""Quality classifier by compression: zstandard dictionaries of good and of bad text; the normalised difference of compressed sizes, calibrated.

Training, on the driver, from a bounded sample of labelled rows (``MAX_PER_CLASS`` documents of each label, lowest hash of the id
first, of up to ``MAX_CHARS`` characters): two thirds make the dictionaries, one third the calibration, a logistic curve over the
difference by Newton steps, moved to the shares that the labels have among all training rows. Scoring reads whole texts, in blocks of
``BLOCK`` bytes, so that long texts profit from the dictionaries as short ones do. The difference is the bytes saved by the good
dictionary for each byte of text, drawn towards its mean as if ``PRIOR_BYTES`` of average text came before: a few words say little.

Inputs of a score: the text alone. Defined cases: null and empty texts have the mean difference and so the curve's value there; a
document with labels of both kinds, or none, trains nothing; with one class or none at all every score is the smoothed share
of label 1. Repeated rows give repeated results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import _base
from curata.plans.storage import materialize

MAX_PER_CLASS = 1500
MAX_CHARS = 30_000
DICTIONARY_BYTES = 96 << 10
BLOCK = 512
PRIOR_BYTES = 64
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    raw: bool
    slope: float
    offset: float
    mean: float = 0.0


def _blocks(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        kind = zstandard.DICT_TYPE_RAWCONTENT if model.raw else zstandard.DICT_TYPE_FULLDICT
        made = [zstandard.ZstdCompressionDict(d, dict_type=kind) if d else None for d in (model.good, model.bad)]
        options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.good, self.bad = (zstandard.ZstdCompressor(dict_data=d, **options) if d else None for d in made)

    def saved(self, text: str | None) -> tuple[int, int]:
        """Bytes that the good dictionary saves against the bad one over all blocks, and the text's bytes."""
        saved = size = 0
        for block in _blocks(text):
            saved += len(self.bad.compress(block)) - len(self.good.compress(block))
            size += len(block)
        return saved, size

    def difference(self, text: str | None) -> float:
        """Saved bytes a byte, drawn towards the mean; higher for good text."""
        if self.good is None or self.bad is None:
            return 0.0
        saved, size = self.saved(text)
        return (saved + PRIOR_BYTES * self.model.mean) / (size + PRIOR_BYTES)

    def __call__(self, text: str | None) -> tuple:
        z = self.model.slope * self.difference(text) + self.model.offset
        score = 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))
        return (score, int(score >= 0.5))


def is_held_out(doc_id: F.Column) -> F.Column:
    """The held-out third: crc32 of the id as text leaves 1 on division by 3. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Sample:
    """Labelled texts, and how many training rows each label has in all."""

    rows: list[tuple[int, str]]
    totals: tuple[int, int]


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_per_class: int = MAX_PER_CLASS, max_chars: int = MAX_CHARS) -> Sample:
    """At most max_per_class (label, text) of each label, none held out; the order, by hash of the id, is the same on every run."""
    marked = (
        labels.select(F.col("doc_id"), F.col(label_col).alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other")
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    totals = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, max_chars))
    # the labels may cover far more ids than the documents: the lowest hashes are taken of the ids that have a usable text
    usable = materialize(marked.select("doc_id", "y").join(texts.select("doc_id"), "doc_id", "left_semi"), "quality_ids")
    ids = None
    for y in (0, 1):
        one = usable.where(F.col("y") == y).orderBy(*order).limit(max_per_class)
        ids = one if ids is None else ids.unionByName(one)
    texts = texts.join(F.broadcast(ids), "doc_id")
    out: list[tuple[int, str]] = []
    for y in (0, 1):
        rows = texts.where(F.col("y") == y).orderBy(*order, "text").limit(max_per_class).collect()
        out += [(y, r["text"]) for r in rows]
    return Sample(out, (totals.get(0, 0), totals.get(1, 0)))


def fit(sample: Sample) -> Model:
    by = {y: [t for label, t in sample.rows if label == y] for y in (0, 1)}
    n0, n1 = sample.totals
    if min(map(len, by.values())) < 3:
        return Model(b"", b"", True, 0.0, math.log((n1 + 1) / (n0 + 1)))
    parts = {y: ([t for i, t in enumerate(ts) if i % 3], ts[::3]) for y, ts in by.items()}
    made: dict[int, bytes] = {}
    raw = False
    for y, (texts, _) in parts.items():
        blocks = [b for t in texts for b in _blocks(t) if len(b) >= 8]
        try:
            made[y] = zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
        except zstandard.ZstdError:  # too few samples to train on
            raw = True
    if raw:
        made = {y: b"".join(b for t in texts for b in _blocks(t))[-DICTIONARY_BYTES:] for y, (texts, _) in parts.items()}
    flat = Scorer(Model(made[1], made[0], raw, 0.0, 0.0))
    counts = {y: [flat.saved(t) for t in held] for y, (_, held) in parts.items()}
    means = {y: sum(s / n for s, n in x) / len(x) for y, x in counts.items()}
    mean = (n1 * means[1] + n0 * means[0]) / (n1 + n0)
    rest = [(y, (s + PRIOR_BYTES * mean) / (n + PRIOR_BYTES)) for y, x in counts.items() for s, n in x]
    slope, offset = logistic(np.array([d for _, d in rest]), np.array([y for y, _ in rest]))
    # the sample's shares are not those of all labelled rows
    offset += math.log(n1 / n0) - math.log(len(counts[1]) / len(counts[0]))
    return Model(made[1], made[0], raw, slope, offset, mean)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> tuple[float, float]:
    """Slope and offset by damped Newton steps, targets drawn in as (n + 1) / (n + 2) so that separable samples stay finite."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.abs(x).max()), 1e-9)
    a = np.column_stack([x / scale, np.ones_like(x)])
    w = np.array([0.0, math.log((n1 + 1) / (n0 + 1))])

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.sum(np.logaddexp(0, z) - t * z) + ridge * w[0] ** 2 / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        grad = a.T @ (p - t) + np.array([ridge * w[0], 0])
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([ridge, 1e-9])
        step, k, before = np.linalg.solve(h, grad), 1.0, loss(w)
        while k > 1e-6 and loss(w - k * step) > before:
            k /= 2
        w = w - k * step
        if float(np.abs(k * step).max()) < 1e-10:
            break
    return float(w[0] / scale), float(w[1])


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted for every document. One pass, no shuffle; the model is 200 kB at most."""
    out = _base.map_texts(docs, lambda: Scorer(model), "score double, predicted int", [id_col], [text_col])
    return out.select(id_col, is_held_out(F.col(id_col)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects; columns as they were."""
    score, predicted = _base.fresh(docs, "score"), _base.fresh(docs, "predicted")
    out = _base.map_texts(docs, lambda: Scorer(model), f"`{score}` double, `{predicted}` int", docs.columns, [text_col])
    return out.where(F.col(predicted) == 1).drop(score, predicted)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.read(spark, sf_dir, "documents")
    return score_quality(docs, fit(training_sample(docs, _base.read(spark, sf_dir, "labels"))))
