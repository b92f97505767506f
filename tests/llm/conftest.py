import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) or (id, text, source)."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture(scope="session")
def awkward(make_docs):
    """Nulls, an empty and a very long text, repeated rows, a null id and source, and columns whose names operators use."""
    from pyspark.sql import functions as F

    long = "alpha beta, gamma. " * 20000
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "no id here", None), (4, "   \t\n"), (5, "é ü \U0001f600 x"), (6, "same words in here today"), (7, "same words in here today", None)]
    d = make_docs(rows)
    for name in ("score", "labels", "spans", "n_words", "size", "taken", "node", "bucket", "digest", "shard", "n_tokens", "adj"):
        d = d.withColumn(name, F.lit("clash"))
    return d


@pytest.fixture(scope="session")
def nothing(make_docs):
    return make_docs([])
