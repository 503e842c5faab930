"""The corpus pipeline: five stages over `documents`, each written and read again before the next.

Quality classifier, exact dedup, SimHash near-dedup, mixing to target weights, best-fit packing. Every stage takes
(spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of documents;
the last returns the packed pieces. A document that the mix takes twice is two rows from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact_dedup, mixing, packing, quality, simhash
from gridloom.llm.common import deleted, scratch_path, scratch_scope, small_batches, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, that with the largest doc_id."""
    return exact_dedup.exact_dedup(docs)


def distinct_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near links join, that with the smallest doc_id.

    Near means shingles of five words and a similarity of 0.8 or more; SimHash proposes them and the shingles decide.
    """
    return simhash.near_dedup(docs, shingle=5)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("SimHash near-dedup", distinct_near),
    ("mixing sources to target weights", to_weights),
    ("best-fit packing", packed),
]

#: The classifier, the fingerprints, the mix and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to `documents`."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.lower().replace(" ", "-"))
        with scratch_scope(spark) as own:
            kept = stage(spark, docs, sf_dir)
            with small_batches(spark):
                kept.write.parquet(path)
        # nothing reads the stage's own tables any more, nor what it was given
        for old in (own, before):
            if old is not None:
                deleted(spark, old)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
