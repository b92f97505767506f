"""Near-duplicates against all pairs; components against union-find; the pipeline against its stages' own rules."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from curata.llm import bpe, dedup, pii, quality
from curata.operators.identity import stars
from tests.llm.test_quality_media import plain_score
from tests.llm.test_tables import fill
from tests.llm.test_text_scans import brute_pii, luhn


def shingles(text, size):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size, percent):
    """id -> (set size by row, smallest reachable id)."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    sets = [(i, shingles(t, size)) for i, t in rows]
    first = {}
    for i, s in sets:
        if i is not None and s:
            join(i, first.setdefault(s, i))
    texts = [(i, s) for s, i in first.items()]
    texts.sort(key=lambda x: len(x[1]))
    for k, (i, a) in enumerate(texts):
        for j, b in reversed(texts[:k]):
            if 100 * len(b) < percent * len(a):  # shorter ones are too short as well
                break
            n = len(a & b)
            if n and 100 * n >= percent * (len(a) + len(b) - n):
                join(i, j)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, n, edits):
    """Groups of near copies of many strengths, chains of them, and texts of their own."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, bases = [], [r.choices(words, k=r.choice([3, 8, 40, 120])) for _ in range(6)]
    for i in range(n):
        t = list(r.choice(bases)) if r.random() < 0.8 else r.choices(words, k=r.choice([1, 2, 5, 50]))
        for _ in range(r.choice(edits)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((i * 3 + 1, " ".join(t)))
    return rows


@pytest.mark.parametrize(("seed", "n", "size", "percent", "small"), [(1, 250, 3, 85, 64), (2, 250, 5, 80, 64), (3, 400, 3, 85, 4)])
def test_all_pairs(make_docs, monkeypatch, seed, n, size, percent, small):
    """The last case makes all but the least buckets large ones, and deals them in small blocks."""
    monkeypatch.setattr(dedup, "SMALL", small)
    if small < 64:
        monkeypatch.setattr(dedup, "SIDE", 16)
    rows = corpus(seed, n, [0, 1, 2, 3, 4, 6, 9])
    assert got(dedup.near_duplicates(make_docs(rows), size, percent)) == brute(rows, size, percent)


def test_op5_on_documents_is_all_pairs(spark):
    """The query as it is, on 1,000 documents: no link is missed and none is made up."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows, 3, 85)
    assert got(dedup.op5_minhash_dedup(spark, sf)) == want
    assert sum(not r[3] for r in want) > 50


def test_blocks_are_cut_by_bytes(make_docs, monkeypatch):
    monkeypatch.setattr(dedup, "SMALL", 4)
    monkeypatch.setattr(dedup, "SIDE_BYTES", 2000)
    rows = corpus(3, 300, [0, 1, 2, 3, 4, 6, 9])
    assert got(dedup.near_duplicates(make_docs(rows), 3, 85)) == brute(rows, 3, 85)


def test_other_id_columns(make_docs):
    docs = make_docs([(9, "one two three four five six"), (4, "one two three four five six")]).select((F.col("doc_id") * 10).alias("key"), "text", "doc_id", F.lit("x").alias("n"))
    out = dedup.drop_near_duplicates(docs, id_col="key")
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(40, "one two three four five six", 4, "x")]


def test_awkward_rows(awkward, nothing, make_docs):
    out = got(dedup.near_duplicates(awkward, 3, 85))
    assert out == brute([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()], 3, 85)
    assert dedup.near_duplicates(nothing, 3, 85).count() == 0
    same_id = [(1, "a b c d e f"), (1, "x y z u v w"), (2, "x y z u v w"), (5, "a b c d e f"), (6, "q")]
    assert {r.doc_id: r.component_id for r in dedup.near_duplicates(make_docs(same_id), 3, 85).collect()} == {1: 1, 2: 1, 5: 1, 6: 6}


def test_one_of_each_group_stays(make_docs):
    docs = make_docs([(9, "one two three four five six"), (4, "one two three four five six"), (7, "other words stand here and there"), (7, "other words stand here and there"), (None, "no id"), (8, ""), (10, None)])
    out = dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == [10, 4, 7, 8, None]


def test_shingle_sets_and_signature(spark):
    s = dedup.Shingler(3)
    a, b = s("A b\tC d"), s("a B c D")
    assert np.array_equal(a, b) and len(a) == 2 and len(s("one")) == 1 and len(s(" ")) == 0
    assert not np.array_equal(s("a b"), s("a b b")) and len(np.intersect1d(s("x y"), s("x y z"))) == 0
    text = [f"t{i}" for i in range(3000)]
    x, y = s(" ".join(text)), s(" ".join(text[:2700]))
    m = dedup.MinHash()
    alike = (m(x) == m(y)).mean()
    assert abs(alike - len(np.intersect1d(x, y)) / len(np.union1d(x, y))) < 0.12


def test_stars_are_union_find(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(80)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent if find(x) != x}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in stars(df, "a", "b").collect()} == want
    assert stars(df.limit(0), "a", "b").count() == 0


SF = "/root/testdata/sf0.001"


def plain_redaction(text):
    """Base kinds by the contract's patterns, the others by patterns of their own; a span that overlaps an earlier one has its rest taken out with it."""
    spans = [(a, b, k.upper()) for k, a, b in brute_pii(text)]
    for m in re.finditer(r"[0-9](?:[ -]?[0-9])+", text):  # cards within longer runs
        if (m.start(), m.end(), "CARD") not in spans:
            at = m.start()
            while c := re.compile(r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])").search(text, at, m.end()):
                good = luhn(re.sub("[^0-9]", "", c.group()))
                spans += [(c.start(), c.end(), "CARD")] * good
                at = c.end() if good else re.compile("[0-9]+").match(text, c.start()).end()
    assert not re.search(r"https?://|ftp://|mailto:", text) and not any(c.lower() in text.lower() for c in pii.CUES)  # the tables hold neither, nor streets with a number
    out, at = "", 0
    for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out, at = out + text[at:a] + f"<{k}>", b
        at = max(at, b)
    return out + text[at:]


def plain_mix(docs):
    """doc_id -> times, by fair queueing over sorted lists."""
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    by = {}
    for r in docs:
        by.setdefault(r.source, []).append(r.doc_id)
    sizes = {s: sum(size[i] for i in ids) for s, ids in by.items()}
    target, names = fill(sizes), sorted(by, key=lambda s: (s is None, s))
    sendings = []
    for rank, s in enumerate(names):
        upto = 0
        for h, i in sorted((int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:15], 16), i) for i in by[s]):
            upto += size[i]
            sendings += [((e * sizes[s] + upto) / target[s], rank, e, h, i) for e in range(3) if size[i]]
    times, total = {}, 0
    for *_, i in sorted(sendings):
        total += size[i]
        if total > sum(sizes.values()):
            break
        times[i] = times.get(i, 0) + 1
    return times


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = list(docs.columns), docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, before, SF)
        kept.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/t/{name}")
        kept = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/t/{name}")
        seen[name] = (before, kept)
        if name != "bpe":
            assert kept.columns == columns
    before, after = seen["quality"]
    model = quality.fit(quality.training_sample(before, spark.read.parquet(f"{SF}/labels.parquet")))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if plain_score(model, r.text) >= 0.5}
    before, after = seen["near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {i for i, _, _, k in brute(rows, 5, 80) if k}
    before, after = seen["pii"]
    assert {(r.doc_id, r.text, r.n_chars) for r in after.collect()} == {(r.doc_id, (t := plain_redaction(r.text)), len(t)) for r in before.collect()}
    before, after = seen["mixture"]
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == plain_mix(before.collect())
    before, after = seen["bpe"]
    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    ids = lambda t: b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids)
    assert sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in after.collect()) == sorted((r.doc_id, len(x := ids(r.text)) // 4, x) for r in before.collect())
    assert after.where(F.col("n_tokens") == 0).count() == 0


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() > 0


def test_stages_take_awkward_and_no_rows(spark, awkward, nothing):
    """Extra columns are left out, nulls and repeated rows go through, and no rows give none."""
    for docs in (awkward, nothing):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            kept = dedup._base.materialize(stage(spark, kept, SF), f"t-{name}")
            if name != "bpe":
                assert kept.columns == list(corpus_pipeline.COLUMNS)
        n = kept.count()
        assert n == 0 if docs is nothing else n > 0
