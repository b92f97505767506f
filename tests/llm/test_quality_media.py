"""Held-out accuracy of the classifier; exact round trips of stored media."""

import collections
import hashlib
import io
import math
import pathlib
import tarfile
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from curata.llm import _base, media, quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = quality.op1_quality(spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in held)
    good, bad = [r for r in held if r.quality == 1], [r for r in held if r.quality == 0]
    assert sum(r.predicted for r in good) / len(good) > 0.95
    assert sum(r.predicted for r in bad) / len(bad) < 0.25
    # area under the curve, by all pairs
    area = sum((g.score > b.score) + 0.5 * (g.score == b.score) for g in good for b in bad) / (len(good) * len(bad))
    assert area > 0.95


def plain_score(model, text):
    """A score by the description: each block of 512 bytes compressed with each dictionary afresh."""
    raw, saved = (text or "").encode(), 0
    for at in range(0, len(raw), 512):
        good, bad = (len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False).compress(raw[at : at + 512])) for d in (model.good, model.bad))
        saved += bad - good
    return 1 / (1 + math.exp(-(model.slope * (saved + 64 * model.mean) / (len(raw) + 64) + model.offset)))


def test_every_score_is_the_plain_one(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(quality.training_sample(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.op1_quality(spark, sf).collect():
        assert math.isclose(r.score, plain_score(model, texts[r.doc_id]), rel_tol=1e-9, abs_tol=1e-12) and r.predicted == int(r.score >= 0.5)


def test_the_curve_is_the_best_logistic_one():
    """No point of a fine grid around it has a lower loss on the same smoothed targets."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0.1, 0.1, 80), r.normal(-0.05, 0.1, 40)])
    y = np.concatenate([np.ones(80), np.zeros(40)])
    slope, offset = quality.logistic(x, y)
    t = np.where(y == 1, 81 / 82, 1 / 42)
    loss = lambda a, b: float(np.sum(np.logaddexp(0, a * x + b) - t * (a * x + b)) + 1e-3 * (a * np.abs(x).max()) ** 2 / 2)
    best = loss(slope, offset)
    assert all(loss(slope + da, offset + db) >= best - 1e-9 for da in (-1, -0.1, 0, 0.1, 1) for db in (-0.5, -0.05, 0, 0.05, 0.5))


def test_keep_good_with_columns_of_its_names(make_docs):
    model = quality.fit(quality.Sample([(1, f"plain words number {i} and more of them to read") for i in range(60)] + [(0, f"BUY NOW!!! {i} $$$ %%% CHEAP") for i in range(60)], (60, 60)))
    docs = make_docs([(1, "plain words number 7 to read"), (2, "BUY NOW!!! $$$ CHEAP")]).withColumn("score", F.lit("s")).withColumn("predicted", F.lit("p")).withColumn("__score", F.lit("t"))
    out = quality.keep_good(docs, model)
    assert out.columns == docs.columns and [(r.doc_id, r.score, r.predicted, r["__score"]) for r in out.collect()] == [(1, "s", "p", "t")]


def test_held_out_is_the_remainder(spark):
    for r in spark.range(200).select("id", quality.is_held_out(F.col("id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1)


def test_training_sees_no_held_out_row_and_is_bounded(spark, make_docs):
    docs = make_docs([(i, f"text {i} " * 9) for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    sample = quality.training_sample(docs, labels, max_per_class=20)
    ids = [int(t.split()[1]) for _, t in sample.rows]
    assert sum(sample.totals) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(300) if i != 4)
    assert len(ids) == 40 and not any(zlib.crc32(str(i).encode()) % 3 == 1 for i in ids)
    assert 4 not in ids  # labels of both kinds
    assert sample == quality.training_sample(docs, labels, max_per_class=20)


def test_classifier_without_labels_or_with_one_class(spark, awkward, nothing):
    for rows in ([], [(3, 1), (6, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        out = quality.score_quality(awkward, quality.fit(quality.training_sample(awkward, labels))).collect()
        assert len(out) == 9 and len({r.score for r in out}) == 1 and all(0 < r.score < 1 for r in out)
    assert quality.score_quality(nothing, quality.fit(quality.Sample([], (0, 0)))).count() == 0


def test_null_and_empty_score_alike(spark, make_docs):
    sample = [(1, f"plain words number {i} and more of them to read") for i in range(60)] + [(0, f"BUY NOW!!! {i} $$$ %%% CHEAP") for i in range(60)]
    out = {r.doc_id: r.score for r in quality.score_quality(make_docs([(1, None), (2, ""), (3, "plain words number 7 to read"), (4, "BUY NOW!!! $$$ CHEAP")]), quality.fit(quality.Sample(sample, (60, 60)))).collect()}
    assert out[1] == out[2] and out[3] > out[1] > out[4] and out[3] > 0.5 > out[4]


def brute_media(text):
    raw = (text or "").encode()
    size = max(192, -(-len(raw) // 192) * 192)
    payload = raw + b" " * (size - len(raw))
    return (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def padded(raw):
    return raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))


def plain_png(raw):
    """The picture written anew from the format's description: rows of 192 grey samples, each after a filter byte of 0."""
    lines = b"".join(b"\0" + padded(raw)[i : i + 192] for i in range(0, len(padded(raw)), 192))
    part = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = (192).to_bytes(4, "big") + (len(lines) // 193).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines, 6)) + part(b"IEND", b"")


def plain_feature(raw):
    data = padded(raw)
    counts = collections.Counter(x // 32 for x in data)
    return f"{'.'.join(str(counts[i]) for i in range(8))};{sum(data) // len(data)};{sum(a != b for a, b in zip(data, data[1:]))}"


def test_equal_payloads_have_one_place(spark, make_docs):
    folder = _base.shared_dir(spark, "media-test")
    docs = make_docs([(i, f"text {i % 7}") for i in range(200)]).repartition(6)
    index = media.store(docs, folder)
    rows = index.collect()
    assert len(rows) == 200 and len({(r.digest, r.shard, r.offset) for r in rows}) == 7
    assert len(members(folder)) == 7  # though several tasks hold them
    assert {(r.doc_id, *brute_media(r.text)) for r in docs.collect()} == {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.read_back(index, folder).collect()}


def members(folder):
    """Names of all that the shards below a folder hold, orphans included."""
    root = pathlib.Path("/" + folder.removeprefix("file:").lstrip("/")) / "media"
    return sorted(m.name for f in root.glob("*.tar") for m in tarfile.open(f))


@pytest.mark.parametrize("few", [1000, 0])
def test_no_payload_is_stored_twice(spark, make_docs, few):
    """Copies over many tasks, texts that differ in trailing spaces alone, null ids and repeated rows; with more copies than may be broadcast, after shards are rewritten."""
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i % 40}") for i in range(240)] + [(300, None), (301, ""), (302, " "), (302, " "), (None, "no id"), (303, "text 5  ")]
    docs = make_docs(rows).repartition(8)
    folder = _base.shared_dir(spark, "media")
    index = media.store(docs, folder, broadcast_rows=few)
    digests = sorted({r.digest.hex() for r in index.collect()})
    if not few:
        assert len(members(folder)) > len(digests)
        target = _base.shared_dir(spark, "compact")
        index, folder = media.compact(index, folder, target), target
    assert members(folder) == [f"{d}.png" for d in digests]
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.read_back(media.fill_metadata(index, folder), folder).collect()), key=repr)
    assert got == sorted(((i, *brute_media(t)) for i, t in rows), key=repr)


def test_media_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = {}
    for r in media.op2_media_columns(spark, "/root/testdata/sf0.001").collect():
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == brute_media(texts[r.doc_id])
        assert (r.width, r.height, r.depth, r.colour) == (192, r.payload_bytes // 192, 8, 0)
        stored = plain_png((texts[r.doc_id] or "").encode())
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), plain_feature((texts[r.doc_id] or "").encode()))
        assert seen.setdefault(texts[r.doc_id], (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_shards_are_tar_files_of_png(spark, awkward, nothing):
    folder = _base.shared_dir(spark, "media-test")
    index = media.store(awkward, folder)
    rows = index.collect()
    assert len(rows) == 9
    found = {}
    for shard in {r.shard for r in rows}:
        with tarfile.open(f"{folder.removeprefix('file://')}/media/{shard}") as t:
            for m in t.getmembers():
                data = t.extractfile(m).read()
                found[shard, m.offset] = (m.name, data)
    for r in rows:
        name, data = found[r.shard, r.offset]
        assert name == f"{r.digest.hex()}.png" and len(data) == r.length
        assert hashlib.sha256(media.from_png(data)).digest() == r.digest
    assert len({r.digest for r in rows}) < len(rows)
    back = media.read_back(media.fill_metadata(index, folder), folder).collect()
    assert {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in back} == {(r.doc_id, *brute_media(r.text)) for r in awkward.collect()}
    empty = _base.shared_dir(spark, "media-test")
    assert media.read_back(media.store(nothing, empty), empty).count() == 0


def test_damage_is_noticed(spark, make_docs):
    folder = _base.shared_dir(spark, "media-test")
    index = media.store(make_docs([(1, "some text")]), folder)
    r = index.first()
    path = f"{folder.removeprefix('file://')}/media/{r.shard}"
    with open(path, "r+b") as f:
        f.seek(r.offset + media.BLOCK + 45)
        f.write(b"\xff\xff")
    with pytest.raises(Exception, match="zlib|is not"):
        media.read_back(index, folder).collect()


def test_png_reads_elsewhere():
    payload = bytes(range(192)) * 3
    data = media.to_png(payload)
    assert media.from_png(data) == payload and media.png_header(data) == (192, 3, 8, 0)
    assert io.BytesIO(data).read(8) == media.SIGNATURE
