"""Exact dedup with a two-pass Bloom filter, in DataFrame functions alone.

Pass 1 counts how many rows hit each slot of a Bloom filter (two slots a row, from one 64-bit hash of the text) and
marks the slots hit at least twice. Pass 2 tests every row: if a slot is unmarked, its hash occurs once, and the row
passes straight through. Only the others shuffle: they are grouped by SHA-256, so a false positive costs a shuffled row,
never a wrong result. Groups are pre-aggregated, so the copies of a hot group don't meet in one task: `exact_dedup` takes
the row that stays by partial maxima, and `duplicate_groups` broadcasts what it says of hot groups.

The filter grows with the rows up to 2^30 slots (see `bloom`); beyond 134 million rows more of them shuffle.

Cases: a null text is the empty text. No rows give no rows. Rows that repeat both a text and the largest doc_id of its
group: `duplicate_groups` reports each as kept; `exact_dedup` keeps one of them, always the same of those that differ in
case or in another column. A null doc_id loses to any other. Very long texts are hashed whole. Further columns are kept by
`exact_dedup`, under whatever names, and ignored by `duplicate_groups`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bloom
from gridloom.llm.common import ascii_lower, hot_join, place_of, plain_names, row_hashes, written


def normal_text(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int | None = None) -> DataFrame:
    """For each row: doc_id, keep_id (largest doc_id of equal texts), group_size, kept, text_sha256."""
    norm = normal_text(F.col(f"`{text_col}`"))
    rows = written(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(norm).alias("h"), F.sha2(norm, 256).alias("text_sha256")), "digests")
    total = rows.count()
    slots = slots or bloom.slots_for(total)
    straight, maybe = bloom.parted(rows, written(bloom.marks(rows, slots, 2), "marks"), "h", slots)
    straight = straight.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = maybe.select("doc_id", "text_sha256")
    groups = written(maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    grouped = hot_join(maybe, groups, "text_sha256", "group_size", total)
    return straight.unionByName(grouped.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int | None = None) -> DataFrame:
    """`docs`, all columns, with one row for each text. Rows whose text surely occurs once don't shuffle."""
    rows, names = plain_names(docs)
    doc_id, norm = F.col(place_of(docs, id_col)), normal_text(F.col(place_of(docs, text_col)))
    rows = rows.withColumn("h", F.xxhash64(norm))
    hashes = written(rows.select("h"), "hashes")
    slots = slots or bloom.slots_for(hashes.count())
    straight, maybe = bloom.parted(rows, written(bloom.marks(hashes, slots, 2), "marks"), "h", slots)
    last = F.struct(doc_id, *row_hashes(rows, names))  # of rows with the largest id, always the same
    stays = maybe.groupBy(F.sha2(norm, 256).alias("sha")).agg(F.max_by(F.struct(*names), last).alias("row"))
    return straight.select(*names).unionByName(stays.select(*(F.col(f"row.{c}").alias(c) for c in names))).toDF(*docs.columns)
