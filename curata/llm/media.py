"""Media columns: content-addressed payloads in tar shards.

A payload is a text's UTF-8 bytes, filled up with spaces to a positive multiple of ``WIDTH``, kept as an 8-bit grey PNG of that
width. Each task writes one tar shard after another, each distinct payload once a task, under its SHA-256; rows carry digest,
shard, offset and length. The index is a Parquet table: only rows of tasks that Spark has committed are in it, so what a
lost or repeated attempt wrote is never referred to. ``fill_metadata`` reads headers alone, by range; ``read_back`` whole payloads.

Each payload is stored once: the digests are aggregated first, and of those that several rows have, the row of the smallest id is told to store it. They are broadcast if they are few by their counted
number; beyond that each task stores what it holds, once, and ``compact`` rewrites the shards without what no row refers to. No text is shuffled. The index names one place for each digest.

Memory: one payload at a time, one shard's open stream and a table of digests of ``SEEN_BYTES``. Shards go to a folder that all executors reach, through pyarrow's file systems.

Defined cases: a null text is an empty one (one row of spaces). Equal texts have equal payloads, media and features.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import _base
from curata.plans.storage import BROADCAST_ROWS, broadcast_if_small

WIDTH = 192
FILL = b" "
SHARD_BYTES = 256 << 20
BLOCK = 512
#: Bytes, by estimate, of a task's table of digests that it has stored; a full one is emptied, and a payload may then be written again.
SEEN_BYTES, SEEN_ENTRY = 64 << 20, 400
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a tar header and of a PNG up to the end of its IHDR chunk.
HEADER_BYTES = BLOCK + 33


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "replace")
    size = max(1, -(-len(raw) // WIDTH)) * WIDTH
    return raw.ljust(size, FILL)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    ihdr = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", ihdr) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, colour type) from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", head[16:26])


def from_png(data: bytes) -> bytes:
    width, height, _, _ = png_header(data)
    at, body = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class ShardWriter:
    """Appends members to tar files below a folder; a new file after SHARD_BYTES."""

    def __init__(self, folder: str, prefix: str) -> None:
        self.fs, self.path = open_fs(folder)
        self.prefix, self.n, self.out = prefix, 0, None

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        """(shard, offset of the member's header, length of its data)."""
        if self.out is None:
            self.shard = f"{self.prefix}-{self.n:04d}.tar"
            self.fs.create_dir(self.path, recursive=True)
            self.out, self.at = self.fs.open_output_stream(f"{self.path}/{self.shard}"), 0
        info = tarfile.TarInfo(name)
        info.size = len(data)
        begin, block = self.at, info.tobuf(tarfile.USTAR_FORMAT) + data + bytes(-len(data) % BLOCK)
        self.out.write(block)
        self.at += len(block)
        if self.at >= SHARD_BYTES:
            shard = self.shard
            self.close()
            return shard, begin, len(data)
        return self.shard, begin, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * BLOCK))
            self.out.close()
            self.out, self.n = None, self.n + 1


INDEX = "n_bytes long, digest binary, shard string, offset long, length long"


def payload_digest(text: Column) -> Column:
    """The SHA-256 of a text's payload, in the JVM."""
    raw = F.coalesce(text.cast("string"), F.lit(""))
    size = F.octet_length(raw)
    return F.unhex(F.sha2(F.concat(raw, F.repeat(F.lit(FILL.decode()), F.when(size == 0, WIDTH).otherwise(F.pmod(-size, F.lit(WIDTH))).cast("int"))), 256))


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", level: int = 6, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Writes the shards and returns the index, read back from its Parquet table: id, n_bytes, digest of the payload, shard, offset, length."""
    _base.ship(docs.sparkSession)
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = frame.schema["id"].dataType.simpleString()
    shared = frame.select("id", payload_digest(F.col("text")).alias("of")).groupBy("of").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("of", "owner")
    shared = _base.materialize(shared, "shared")
    if shared.limit(broadcast_rows + 1).count() <= broadcast_rows:
        told = frame.withColumn("key", payload_digest(F.col("text"))).join(F.broadcast(shared), F.col("key") == F.col("of"), "left")
        frame = told.select("id", "text", (F.col("of").isNull() | F.col("id").eqNullSafe(F.col("owner"))).alias("own"))
    else:
        frame = frame.withColumn("own", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = ShardWriter(f"{folder}/media", f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}")
        there: dict[bytes, tuple[str, int, int]] = {}
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, _base.SLICE):
                    part = batch.slice(at, _base.SLICE)
                    rows = []
                    for text, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                        payload = payload_of(text)
                        digest = hashlib.sha256(payload).digest()
                        if own and digest not in there:
                            if len(there) * SEEN_ENTRY >= SEEN_BYTES:
                                there.clear()
                            there[digest] = writer.add(f"{digest.hex()}.png", to_png(payload, level))
                        rows.append((len((text or "").encode("utf-8", "replace")), digest, *(there[digest] if own else (None, None, None))))
                    cols = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=[id_col, "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            writer.close()

    index = frame.mapInArrow(run, f"`{id_col}` {kind}, {INDEX}")
    index.write.parquet(f"{folder}/written")
    return one_place(docs.sparkSession.read.schema(index.schema).parquet(f"{folder}/written"), folder)


PLACE = ("shard", "offset", "length")


def one_place(written: DataFrame, folder: str) -> DataFrame:
    """The index with one place for each digest. Only digests with a row that has another place, or none, are joined; they are broadcast if they are few by their counted number."""
    place = F.when(F.col("shard").isNotNull(), F.struct(*PLACE))
    several = written.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count_if(F.col("shard").isNull()).alias("without")).where("first <> last OR without > 0")
    several = _base.materialize(several.select(F.col("digest").alias("of"), "first"), "places")
    kept = written.join(broadcast_if_small(several), F.col("digest") == F.col("of"), "left")
    moved = [F.coalesce(F.col(f"first.{c}"), F.col(c)).alias(c) if c in PLACE else F.col(f"`{c}`") for c in written.columns]
    index = kept.select(*moved)
    index.write.parquet(f"{folder}/index")
    return written.sparkSession.read.schema(written.schema).parquet(f"{folder}/index")


def compact(index: DataFrame, folder: str, target: str) -> DataFrame:
    """Copies what an index refers to into shards below ``target``, each payload once, and returns the index with the new places. A payload is copied as it lies, by the task that has its old shard."""
    _base.ship(index.sparkSession)
    old = _base.materialize(index.groupBy("digest").agg(F.min(F.struct(*PLACE)).alias("p")).select("digest", "p.*"), "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, reader = TaskContext.get(), RangeReader(folder)
        writer = ShardWriter(f"{target}/media", f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}")
        try:
            for b in batches:
                rows = [(d, *writer.add(f"{d.hex()}.png", reader.read(shard, offset + BLOCK, length))) for d, shard, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["of", "shard", "offset", "length"])
        finally:
            writer.close()

    new = old.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(run, "of binary, shard string, offset long, length long")
    new.write.parquet(f"{target}/places")
    places = index.sparkSession.read.parquet(f"{target}/places")
    return index.drop(*PLACE).join(places, F.col("digest") == F.col("of")).drop("of").select(*index.columns)


class RangeReader:
    """Reads ranges of a folder's shards; keeps the last shard open (the index lists a task's rows in the order of their shard)."""

    def __init__(self, folder: str) -> None:
        self.fs, self.path = open_fs(f"{folder}/media")
        self.shard, self.file = None, None

    def read(self, shard: str, offset: int, size: int) -> bytes:
        if shard != self.shard:
            if self.file is not None:
                self.file.close()
            self.shard, self.file = shard, self.fs.open_input_file(f"{self.path}/{shard}")
        data = self.file.read_at(size, offset)
        if len(data) != size:
            raise OSError(f"{shard}: {len(data)} bytes of {size} at {offset}")
        return data


class HeaderReader(RangeReader):
    def __call__(self, shard: str, offset: int) -> tuple:
        head = self.read(shard, offset, HEADER_BYTES)
        width, height, depth, colour = png_header(head[BLOCK:])
        return (tarfile.TarInfo.frombuf(head[:BLOCK], "utf-8", "strict").name, width, height, depth, colour)


class PayloadReader(RangeReader):
    def __call__(self, shard: str, offset: int, length: int, digest: bytes) -> tuple:
        data = self.read(shard, offset + BLOCK, length)
        payload = from_png(data)
        found = hashlib.sha256(payload)
        if found.digest() != digest:
            raise OSError(f"{shard}: the payload at {offset} is not {digest.hex()}")
        return (len(payload), found.hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload))


def feature(payload: bytes) -> str:
    """Counts of the samples by their upper three bits, the rounded-down mean, and the number of samples unlike the one before."""
    a = np.frombuffer(payload, dtype=np.uint8)
    bins = np.bincount(a >> 5, minlength=8)
    return f"{'.'.join(map(str, bins))};{int(a.sum(dtype=np.int64)) // len(a)};{int(np.count_nonzero(a[1:] != a[:-1]))}"


def fill_metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index with member name, width, height, depth and colour type, from ranges of 545 bytes."""
    return _base.map_texts(index, lambda: HeaderReader(folder), "member string, width long, height long, depth int, colour int", index.columns, ["shard", "offset"])


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """The index with what the stored bytes hold: payload size and digests, media size and digest, feature."""
    made = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _base.map_texts(index, lambda: PayloadReader(folder), made, index.columns, ["shard", "offset", "length", "digest"])


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _base.shared_dir(spark, "media")
    index = store(_base.read(spark, sf_dir, "documents"), folder)
    rows = read_back(fill_metadata(index, folder), folder)
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth", "colour")
