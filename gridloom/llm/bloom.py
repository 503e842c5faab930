"""A Bloom filter of 64-bit hashes as a table of bitmaps, built and asked in DataFrame functions alone.

A hash has two slots, one from either half. `marks` counts how many rows hit each slot and keeps those hit often enough
in bitmaps of 32,768 bits; `asked` looks every row's slots up in the broadcast bitmaps, without a shuffle. The slots are a
power of two, eight for each row that is expected, 2^30 at most: what is broadcast has 128 MB at most, whatever the input.
With more rows than an eighth of that (134 million) the filter fills and lets more rows pass: one in twenty at 134
million, two in five at 540 million, three in four at a billion. Callers look at those that pass exactly, so results stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots for each row, and the fewest and most slots.
SLOTS_A_ROW = 8
LEAST_SLOTS = 1 << 15
MOST_SLOTS = 1 << 30
#: Bits in one bitmap of Spark's bitmap functions.
BITMAP_LOG = 15
BITMAP_BITS = 1 << BITMAP_LOG


def slots_for(rows: int) -> int:
    """Slots for so many rows: a power of two."""
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (SLOTS_A_ROW * max(rows, 1) - 1).bit_length()))


def _slots(h: Column, slots: int) -> list[Column]:
    """Two slots from the halves of a 64-bit hash."""
    return [h.bitwiseAND(F.lit(slots - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(slots - 1))]


def marks(hashes: DataFrame, slots: int, least: int = 1) -> DataFrame:
    """From a column `h`, bitmaps (bucket, bits) of the slots that `least` rows or more hit."""
    hit = hashes.select(F.explode(F.array(*_slots(F.col("h"), slots))).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    bit = F.col("slot").bitwiseAND(F.lit(BITMAP_BITS - 1))
    return hit.filter(F.col("n") >= least).groupBy(F.shiftright("slot", BITMAP_LOG).alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))


def asked(rows: DataFrame, marked: DataFrame, h: str, flag: str, slots: int) -> DataFrame:
    """`rows` (none of whose columns begins with bloom_) with a boolean `flag`: false if a slot of the hash in column `h` is unmarked."""
    columns, hit = rows.columns, F.lit(True)
    for i, slot in enumerate(_slots(F.col(h), slots)):
        bits, bucket = f"bloom_bits{i}", f"bloom_bucket{i}"
        side = F.broadcast(marked.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits)))
        rows = rows.join(side, F.shiftright(slot, BITMAP_LOG) == F.col(bucket), "left")
        at = slot.bitwiseAND(F.lit(BITMAP_BITS - 1)).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("bigint")
        hit = hit & F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1, F.lit(False))
    return rows.select(*columns, hit.alias(flag))


def parted(rows: DataFrame, marked: DataFrame, h: str, slots: int) -> tuple[DataFrame, DataFrame]:
    """`rows` surely not among the marked, and those that may be. Neither shuffles."""
    tested = asked(rows, marked, h, "bloom_maybe", slots)
    return tested.filter("NOT bloom_maybe").drop("bloom_maybe"), tested.filter("bloom_maybe").drop("bloom_maybe")
