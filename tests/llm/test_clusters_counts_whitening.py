"""Centroid clustering, token counts and whitening: SQL, the tokenizer library and exact fractions."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curata.llm import centroids, tokens, whitening
from tests.oracle import connect, rows, sql_rows

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, cluster string, distance string, of string, n string, x string, dims string, component string, digest string"


def vectors(spark, given):
    """Of (id, vector), with columns whose names the operators use."""
    return spark.createDataFrame([(i, v, *["clash"] * 8) for i, v in given], VECTORS)


# centroids


def test_centroids_sql(spark):
    assert rows(centroids.op11_centroids(spark, SF)) == sql_rows(connect(), centroids.ORACLE)


def plain_clusters(given, k, dims, rounds, seed="2"):
    """In Python's integers: (id, cluster, distance), digest of each centroid."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in given if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in good if i is not None)[:k]
    c = [v for _, v in first]
    if not c:
        return [], []
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        by = {}
        for _, v in good:
            by.setdefault(near(v), []).append(v)
        c = [[sum(x) // len(by[j]) for x in zip(*by[j], strict=True)] if j in by else c[j] for j in range(len(c))]
    return [(i, near(v), far(v, c[near(v)])) for i, v in good], [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]


@pytest.mark.parametrize("scale", [0.01, 1.0, 1e6, 1e18, 1e150])
def test_centroids_against_plain_integers(spark, scale):
    """Ties, repeated rows, null ids and what takes no part, at sizes where float32, longs and doubles give out."""
    r = random.Random(3)
    grid = [[scale * r.choice([-1, 0, 1, 2]) for _ in range(4)] for _ in range(60)]
    given = [(i, v) for i, v in enumerate(grid)] + [(i, grid[i]) for i in range(5)] + [(None, grid[0])] + [(900 + i, [scale * r.uniform(-2, 2) for _ in range(4)]) for i in range(60)]
    bad = [(1000, None), (1001, []), (1002, [1.0] * 3), (1003, [1.0, None, 0.0, 0.0]), (1004, [math.nan] * 4), (1005, [math.inf, 0.0, 0.0, 0.0]), (1006, [1.7e308] * 4)]
    want, digests = plain_clusters(given + bad, 7, 4, 3)
    got = centroids.cluster(vectors(spark, given + bad), k=7, dims=4, rounds=3).collect()
    cut = lambda x: min(x, 2**63 - 1)
    inertia = {}
    for _, c, d in want:
        inertia[c] = inertia.get(c, 0) + cut(d)
    expected = [(i, c, cut(d), cut(inertia[c]), cut(sum(inertia.values())), digests[c]) for i, c, d in want]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_screening_keeps_the_nearest():
    """Intervals: the nearest is never out, and few others stay."""
    g = np.random.default_rng(5)
    for scale in (1, 300, 1e5, 1e9):
        v = np.floor(g.normal(size=(300, 64)) * scale)
        c = centroids.Centroids([[int(x) for x in row] for row in np.vstack([np.floor(g.normal(size=(20, 64)) * scale), v[:20], v[:5] + 1])])
        exact = [[sum((int(x) - y) ** 2 for x, y in zip(row, k, strict=True)) for k in c.rows] for row in v]
        may = c.screen(v)
        assert all(may[i, d.index(min(d))] for i, d in enumerate(exact)) and may.mean() < 0.2
        assert c.nearest(v).tolist() == [d.index(min(d)) for d in exact]
    far = centroids.Centroids([[10**25 * (i == j) for j in range(64)] for i in range(64)])
    assert far.screen(np.eye(64) * 1e25).all()  # products beyond float32 tell nothing


def test_centroids_of_few_or_no_rows(spark):
    assert centroids.cluster(vectors(spark, [])).count() == 0
    assert centroids.cluster(vectors(spark, [(None, [1.0] * 64)])).count() == 0
    got = centroids.cluster(vectors(spark, [(1, [1.0] * 64), (1, [1.0] * 64), (2, [0.0] * 64)])).collect()
    assert [(r.vec_id, r.distance, r.inertia) for r in sorted(got)] == [(1, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert len({r.cluster for r in got}) == 2


def test_centroids_agree_on_any_layout(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert rows(centroids.cluster(df.repartition(7))) == rows(centroids.cluster(df.coalesce(1)))


# token counts


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokens.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_counts_are_the_librarys(library):
    """Pieces cut at spaces, parts of five characters and a table that is always full, against whole texts."""
    wide, narrow, r = tokens.Counter(tokens.default_path()), tokens.Counter(tokens.default_path(), part=5, room=2000), random.Random(1)
    bits = ["the", " ", "  ", "\n", " \n", "'s", "é", "　", "\x1c", "\x85", "​", "<|endoftext|>", "<|endof", "1", "!", "́", "中", " a", "\t", "\U0001f600", "᠎", "\xa0"]
    for _ in range(5000):
        text = "".join(r.choices(bits, k=r.randint(0, 14)))
        assert wide(text) == narrow(text) == len(library.encode(text, add_special_tokens=False)), text


def test_token_counts_on_documents(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = tokens.op12_token_counts(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False))
        assert tuple(r) == (r.doc_id, len((texts[r.doc_id] or "").encode()), n, n > 512)


def cached(spark, cache):
    return sorted((bytes(r.digest), r.n_tokens) for r in spark.read.parquet(cache).collect())


@pytest.mark.parametrize("few", [0, 1000])
def test_cache_is_read_and_appended(spark, make_docs, tmp_path, few):
    """Only distinct misses are encoded: what the cache says is taken, and appends hold new contents alone. With both sides dealt by digest and with one broadcast."""
    path, cache = tokens.default_path(), f"file://{tmp_path}/cache"
    count = lambda docs: {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, path, cache, broadcast_rows=few).collect()}
    assert count(make_docs([(i, "one two") for i in range(50)] + [(50, "three"), (51, None), (52, "")])) == {i: 2 for i in range(50)} | {50: 1, 51: 0, 52: 0}
    first = cached(spark, cache)
    assert [n for _, n in sorted(first, key=lambda x: x[1])] == [0, 1, 2]
    # a stored count that no encoder would give shows where counts come from
    false = spark.createDataFrame([(hashlib.sha256(b"planted").digest(), 77, tokens.tokenizer_digest(path))], tokens.CACHE)
    false.write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert count(make_docs([(1, "planted"), (2, "one two"), (3, "four five six"), (4, "four five six")])) == {1: 77, 2: 2, 3: 3, 4: 3}
    assert len(cached(spark, cache)) == len(first) + 2
    before = sorted(p.name for p in tmp_path.rglob("*.parquet"))
    assert count(make_docs([(1, "planted")] * 3)) == {1: 77} and sorted(p.name for p in tmp_path.rglob("*.parquet")) == before
    # another tokenizer's counts are apart
    assert {r.n_tokens for r in tokens.token_counts(make_docs([(1, "planted")]), __import__("public_tokenizers").path("word_bpe_49k.json"), cache).collect()} != {77}


def test_other_libraries(make_docs, tmp_path):
    import public_tokenizers as P
    import sentencepiece

    texts = ["Hello  World, ÉCOLE", "", "a b c\n\nd", "<|endoftext|> x"]
    word, piece = Tokenizer.from_file(P.path("word_bpe_49k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = make_docs(list(enumerate(texts)))
    for name, want in (("word_bpe_49k.json", [len(word.encode(t, add_special_tokens=False)) for t in texts]), ("piece_bpe_32k.model", [len(piece.encode(t)) for t in texts])):
        assert [r.n_tokens for r in tokens.token_counts(docs, P.path(name), f"file://{tmp_path}/{name}").orderBy("doc_id").collect()] == want


def test_token_counts_of_awkward_rows(awkward, nothing, tmp_path):
    path = tokens.default_path()
    out = tokens.token_counts(awkward, path, f"file://{tmp_path}/a").collect()
    assert len(out) == 9 and {(r.n_bytes, r.n_tokens, r.over_limit) for r in out if r.doc_id in (1, 2)} == {(0, 0, False)}
    assert all(r.over_limit for r in out if r.doc_id == 3) and [r.n_tokens for r in out if r.doc_id is None] == [3]
    assert tokens.token_counts(nothing, path, f"file://{tmp_path}/b").count() == 0


# whitening


def exact_covariance(distinct):
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = [[Fraction(n * x - s, n) for x, s in zip(v, sums, strict=True)] for v in distinct]
    d = range(len(sums))
    return n, sums, [[sum(v[i] * v[j] for v in centred) / n for j in d] for i in d]


@pytest.mark.parametrize("scale", [1.0, 1e-2, 1e7, 1e12])
def test_covariance_and_eigenvectors_against_fractions(scale):
    """Columns of very unlike sizes and a mean far from zero: high and low parts together are right to 100 bits, eigenvectors to double precision."""
    r = random.Random(9)
    v = sorted({tuple(math.floor(256 * (scale * (10.0**j * r.gauss(0, 1) + 1000))) for j in range(-2, 2)) for _ in range(2500)})
    n, sums, exact = exact_covariance(v)
    mean, g = whitening.Mean(n, sums), whitening.Gram(4)
    x = np.array(v, dtype=np.int64)
    for at in range(0, n, whitening.ROWS):
        g.add(*mean.centred(x[at : at + whitening.ROWS]))
    for i in range(4):
        for j in range(4):
            got = (Fraction(float(g.hi[i, j])) + Fraction(float(g.lo[i, j]))) / n
            assert (got - exact[i][j]) ** 2 <= exact[i][i] * exact[j][j] * Fraction(1, 2**190)
    values, u = whitening.eigen(g.hi, g.lo)
    trace = sum(exact[i][i] for i in range(4))
    for k in range(4):
        w = [Fraction(float(x)) for x in u[:, k]]
        e = Fraction(float(values[k])) / n
        for i in range(4):
            assert abs(sum(exact[i][j] * w[j] for j in range(4)) - e * w[i]) <= trace * Fraction(1, 2**50)
    assert list(values) == sorted(values, reverse=True) and np.abs(u.T @ u - np.eye(4)).max() < 1e-15


def test_close_eigenvalues_cost_no_digits():
    """Two eigenvalues a millionth apart: a plain double solve loses six digits, the refined one none."""
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(8, 8)))
    e = np.array([3.0, 2.000001, 2.0, 1, 0.5, 0.25, 0.1, 0.01])
    a = (q.astype(np.longdouble) * e) @ q.T.astype(np.longdouble)
    hi = a.astype(np.float64)
    _, u = whitening.eigen(hi, (a - hi).astype(np.float64))
    x = u.astype(np.longdouble)
    rest = x.T @ a @ x
    assert np.abs(rest - np.diag(np.diag(rest))).max() < 1e-15


def plain_whitening(given, components=4):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in given]
    distinct = sorted({tuple(v) for _, v in good})
    n, sums, exact = exact_covariance(distinct)
    e, u = np.linalg.eigh(np.array([[float(x) for x in row] for row in exact]))
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, v in good:
        d = [n * x - s for x, s in zip(v, sums, strict=True)]
        out[i] = (sum(x * x for x in d), [float(np.dot([float(Fraction(x, n)) for x in d], u[:, k]) / math.sqrt(e[k])) if e[k] > 1e-12 * e[0] else None for k in range(min(components, len(sums)))])
    return n, out, e


def compare(got, given, n, want, e):
    k = len(next(iter(want.values()))[1])
    assert len(got) == len(given) * k
    sign = {}
    for r in got:
        deviation, w = want[r.vec_id]
        assert (r.n, r.deviation) == (n, min(deviation, 2**63 - 1)) and math.isclose(r.explained, max(e[r.component - 1], 0) / sum(e), rel_tol=1e-9, abs_tol=1e-15)
        x = w[r.component - 1]
        if x is None:
            assert r.whitened is None
        else:
            if abs(x) > 1e-6:
                sign.setdefault(r.component, math.copysign(1, x * r.whitened))
            assert math.isclose(r.whitened * sign.get(r.component, 1), x, rel_tol=1e-8, abs_tol=1e-8)
        assert r.identity_error < 1e-9


def test_whitening_on_the_tables(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    given = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    compare(whitening.op13_whitening(spark, SF).collect(), given, *plain_whitening(given))


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e14])
def test_whitening_of_awkward_rows(spark, scale):
    """Repeated vectors count once in the fit and keep their rows; what cannot take part has none; a dimension that never varies; deviations beyond a long."""
    r = random.Random(4)
    given = [(i, [scale * r.gauss(0, 3), scale * r.gauss(0, 2), scale * r.gauss(0, 1), scale, scale * r.gauss(0, 0.5)]) for i in range(40)]
    given += [(100 + i, given[0][1]) for i in range(30)]
    bad = [(1, None), (2, []), (3, [1.0, None, 1.0, 1.0, 1.0]), (4, [math.nan] * 5), (5, [math.inf] + [0.0] * 4), (6, [1.0] * 3)]
    got = whitening.whiten(vectors(spark, given + bad).repartition(5), components=5).collect()
    compare(got, given, *plain_whitening(given, 5))
    assert whitening.whiten(vectors(spark, [*given, (None, given[1][1])])).where(F.col("vec_id").isNull()).count() == 4


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0 and whitening.whiten(vectors(spark, [(1, [1.0])]), dims=3).count() == 0
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [tuple(r)[1:] for r in got] == [(k, 1, 0, None, None, None) for k in (1, 2)] * 2
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1e300, -1e300])])).collect()
    assert len(one) == 6 and all(r.deviation == 2**63 - 1 for r in one)


def test_whitening_merges_many_tasks(spark):
    """More tasks than one level of merging takes."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = whitening.fit_list(df, "embedding").select("x")
    mean = whitening.sums(x, 64)
    a, b = (whitening.gram(x.repartition(k), 64, 64, mean.centred) for k in (1, 3 * whitening.FAN))
    assert np.abs((a[0] - b[0]) + (a[1] - b[1])).max() <= 1e-25 * np.abs(a[0]).max()
