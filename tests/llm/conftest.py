import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text[, source])."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def some(spark):
    """The first documents of the small table, with odd ones: null, empty, blank, very long, repeated."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 120")
    top = base.agg(F.max("doc_id")).first()[0]
    odd = [None, "", " \t\n", "one", "ONE", "a b c", "word " * 30_000, "Same text here, five words.", "SAME text here, five words.", "é ß Ö 漢字 🙂"]
    extra = spark.createDataFrame([(top + 1 + i, t, None, None if i % 3 == 0 else f"odd{i % 3}", 0) for i, t in enumerate(odd)], SCHEMA)
    return base.unionByName(extra).cache()
