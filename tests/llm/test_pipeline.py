import collections

import corpus_pipeline
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, quality
from gridloom.llm.queries import ORACLE_SQL, QUERIES


def test_stages(spark, some):
    docs, kept = some, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, None).cache()
        kept.append((name, docs, out))
        docs = out
    for _, _, out in kept[:-1]:
        assert out.dtypes == some.dtypes
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = kept
    ids = lambda x: collections.Counter(r["doc_id"] for r in x.select("doc_id").collect())
    assert 0 < b.count() < a.count() and set(ids(b)) <= set(ids(a))
    assert ids(c) == ids(exact_dedup.duplicate_groups(b).filter("kept"))
    assert set(ids(d)) <= set(ids(c)) and max(ids(d).values()) == 1
    assert set(ids(e)) <= set(ids(d)) and max(ids(e).values()) <= 3
    assert {k: v for k, v in ids(f.filter("piece = 0")).items()} == dict(ids(e))


def test_the_classifier_is_fitted_on_all_rows(spark, monkeypatch):
    """More documents than any sample of 10,000: votes are counted, weights fitted and the cut found among all of them."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    docs = docs.unionByName(docs.filter("doc_id % 4 = 0").withColumn("doc_id", F.col("doc_id") + 10_000_000))
    n, seen = docs.count(), collections.defaultdict(list)
    label_model, of_all, quantile = quality.label_model, quality._curve_of_all, quality.quantile

    def labelled(patterns, counts):
        seen["voted"].append(counts.sum())
        out = label_model(patterns, counts)
        seen["sure"].append(counts[out[0] > quality.SURE].sum())
        return out

    monkeypatch.setattr(quality, "label_model", labelled)
    monkeypatch.setattr(quality, "_curve_of_all", lambda rows, *more: seen["fitted"].append(rows.count()) or of_all(rows, *more))
    monkeypatch.setattr(quality, "quantile", lambda keys, share: seen["cut"].append(keys.count()) or quantile(keys, share))
    assert 0 < corpus_pipeline.good_quality(spark, docs, None).count() < n
    assert n > 12_000 and seen["voted"] == [n] and set(seen["fitted"]) == {n} and seen["cut"] == seen["sure"] and seen["sure"][0] > n / 2


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
