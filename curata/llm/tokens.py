"""Token counts behind a digest cache.

The cache is a Parquet table of (digest of the normalised content, number of tokens), in a folder for each digest of the tokenizer's version: file bytes, library
and its version. A call writes a slim table (id, digest, bytes) of all documents, finds the digests that the cache has not, counts the tokens of one text of each
and appends the counts; then every row takes its count from the cache. Texts whose digests the cache has are never encoded again, in this call or a later one.

**Content.** A null text is normalised to the empty one. No other folding (NFC, case, white space) is safe: the counts that the library gives depend on it, even in front of
a tokenizer that folds by itself, as special strings are looked for before.

**Where rows go.** One text a digest and task is shuffled, so copies meet as few rows, whatever their number. The missed digests are broadcast if their counted number is small, so that
known texts stay where they are; else both sides are dealt by digest. Counts come back by digest to the slim table: broadcast if few, else a join whose hot keys adaptive execution splits.

**Counting.** Texts go to the library. For byte-level files without a normaliser a text is first cut at single spaces between other characters, where the library's split
always starts a new word, whatever its table of letters; counts of such pieces are kept in a table of ``TABLE_BYTES`` in front of the library. A text is read in parts of
``PART`` characters, cut at such places; a run without one is held whole.

**Appends.** A job writes its counts by Spark's commit; what a lost attempt wrote is not seen. Calls at the same time may append the same digest twice, with the same count: readers take one.

Defined cases: repeated rows and null ids keep a row each; empty texts have no tokens.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import _base
from curata.plans.storage import BROADCAST_ROWS

LIMIT = 512
PART = 1 << 16
TABLE_BYTES, TABLE_ENTRY = 128 << 20, 150
#: Bytes of digests, by estimate, that a task holds while it leaves out copies; a full set is emptied, and copies may then be shuffled.
SEEN_BYTES, SEEN_ENTRY = 64 << 20, 100
#: The session's setting that names a lasting cache for the query; unset, each call begins an empty one.
CACHE_KEY = "spark.curata.tokenCache"
CACHE = "digest binary, n_tokens long, tokenizer string"
#: Where a text may be cut, and white space that makes looking for such places worth while; without it every single space is one.
CUT, ODD = re.compile(r"(?<=\S)(?= \S)"), re.compile(r"[^\S \n]")


def tokenizer_digest(path: str) -> str:
    """Digest of what decides the counts: the file, the library and its version."""
    library = __import__("sentencepiece" if path.endswith(".model") else "tokenizers")
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + f.read()).hexdigest()


class Known(dict):
    """Tokens of pieces with a space in front; pieces that it has not are noted, and count as none."""

    def __init__(self) -> None:
        self.missed: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.missed.append(piece)
        return 0


class Counter:
    """Numbers of tokens of texts, by the library for the file."""

    def __init__(self, path: str, part: int = PART, room: int = TABLE_BYTES) -> None:
        self.part, self.room, self.size = part, room, 0
        self.known = Known()
        self.cuts = False
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library: Callable[[list[str]], list[int]] = lambda texts: [len(pieces.encode(t)) for t in texts]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        words = Tokenizer.from_file(path)
        words.no_truncation()
        words.no_padding()
        self.library = lambda texts: [len(e) for e in words.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        split, added = doc.get("pre_tokenizer") or {}, doc.get("added_tokens", [])
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not doc.get("normalizer")
        self.cuts = plain and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in added)

    def pieces(self, words: list[str]) -> int:
        """Tokens of words, each with a space in front."""
        total, missed = sum(map(self.known.__getitem__, words)), self.known.missed
        if missed:
            self.known.missed = []
            new = list(dict.fromkeys(missed))
            counts = dict(zip(new, self.library([" " + w for w in new]), strict=True))
            total += sum(map(counts.__getitem__, missed))
            self.size += sum(map(len, new)) + TABLE_ENTRY * len(new)
            if self.size > self.room:
                self.known, self.size = Known(), 0
            else:
                self.known.update(counts)
        return total

    def whole(self, part: str) -> int:
        """Tokens of a part that starts and ends where words do."""
        if "  " in part or " \n" in part or "\n " in part or part.endswith(" ") or ODD.search(part):
            at = [0, *(m.start() for m in CUT.finditer(part)), len(part)]
            words = [part[a:b] for a, b in itertools.pairwise(at)]
            return self.library(words[:1])[0] + self.pieces([w[1:] for w in words[1:]])
        if part[:1] == " ":
            return self.pieces(part[1:].split(" "))
        first, *rest = part.split(" ")
        return self.library([first])[0] + self.pieces(rest)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.cuts:
            return self.library([text])[0]
        n, at = 0, 0
        while at < len(text):
            cut = CUT.search(text, at + self.part) if len(text) - at > self.part else None
            end = cut.start() if cut else len(text)
            n += self.whole(text[at:end])
            at = end
        return n


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each worker process and file."""
    return Counter(path)


def content(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(content(text), 256))


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """digest, n_tokens of one tokenizer's counts; each digest once."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def once_a_task(texts: DataFrame) -> DataFrame:
    """(digest, text) with a task's copies left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            stays = []
            for digest in batch.column(0).to_pylist():
                stays.append(digest not in seen)
                if len(seen) * SEEN_ENTRY >= SEEN_BYTES:
                    seen.clear()
                seen.add(digest)
            yield batch.filter(pa.array(stays))

    return texts.mapInArrow(run, texts.schema)


def encode_distinct(texts: DataFrame, path: str) -> DataFrame:
    """digest, n_tokens of (digest, text), where the copies of a digest are in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, done = counter(path), set()
        for batch in batches:
            digests, counts = [], []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest not in done:
                    if len(done) * SEEN_ENTRY >= SEEN_BYTES:
                        done.clear()
                    done.add(digest)
                    digests.append(digest)
                    counts.append(count(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return texts.mapInArrow(run, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each document: id, n_bytes, n_tokens, over_limit (more tokens than limit). cache is a folder that driver and executors reach; it need not exist."""
    spark = docs.sparkSession
    _base.ship(spark)
    version, text = tokenizer_digest(path), F.col(f"`{text_col}`")
    rows = _base.materialize(docs.select(F.col(f"`{id_col}`").alias("id"), content_digest(text).alias("digest"), F.octet_length(content(text)).cast("long").alias("n_bytes")), "digests")
    known = read_cache(spark, cache, version)
    missed = _base.materialize(rows.select("digest").distinct().join(known, "digest", "left_anti"), "missed")
    n = missed.limit(broadcast_rows + 1).count()
    if n:
        texts = once_a_task(docs.select(content_digest(text).alias("digest"), content(text).alias("text")))
        if n <= broadcast_rows:
            dealt = texts.join(F.broadcast(missed), "digest", "left_semi").repartition("digest")
        else:
            dealt = texts.join(missed.hint("shuffle_hash"), "digest", "left_semi")
        counts = encode_distinct(dealt.select("digest", "text"), path).withColumn("tokenizer", F.lit(version))
        counts.write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = read_cache(spark, cache, version).withColumnRenamed("digest", "of")
    if counts.limit(broadcast_rows + 1).count() <= broadcast_rows:
        counts = F.broadcast(counts)
    out = rows.join(counts, F.col("digest") == F.col("of"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = spark.conf.get(CACHE_KEY, None) or _base.shared_dir(spark, "token-counts")
    return token_counts(_base.read(spark, sf_dir, "documents"), default_path(), cache)
