"""Places in a global order, and digests of long runs, without one task that sees all rows.

`in_order` range-partitions rows and writes them with their part and their place in it. `numbered` and `running` turn that
into places and sums over the whole table or within groups, by offsets of the parts: one row a part and group, so that a
group may fill many parts. `sequential_sha256` hashes pieces in order as a stream, which holds one piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import written

#: Fixed value: bits of a row's place within its partition in what monotonically_increasing_id gives.
PLACE_BITS = 33


def in_order(df: DataFrame, name: str, *by: Column | str) -> DataFrame:
    """`df`, written in the order of `by`, with its `part` and its place `at` there. Rows that tie in `by` must be equal."""
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    rows = rows.withColumn("part", F.shiftright("at", PLACE_BITS)).withColumn("at", F.col("at").bitwiseAND((1 << PLACE_BITS) - 1))
    return written(rows, name)


def numbered(rows: DataFrame, group: str) -> DataFrame:
    """Rows of `in_order`, whose order begins with `group` (never null), with their place `idx` in the group, from 0, and its size `n`."""
    runs = rows.groupBy("part", group).agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("here"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("part", group, (before - F.col("first_at")).alias("shift"), F.sum("here").over(whole).alias("n"))
    return rows.join(runs, ["part", group]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def running(rows: DataFrame, part: str, at: str, sums: dict[str, Column]) -> DataFrame:
    """`rows` with running sums, the row's own value included, over the order of (part, at). There are few parts: one row of each meets in a window."""
    own = {name: f"{name}_own" for name in sums}
    rows = rows.select("*", *(value.alias(own[name]) for name, value in sums.items()))
    parts = rows.groupBy(part).agg(*(F.sum(c).alias(c) for c in own.values()))
    before = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(part, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{name}_before") for name, c in own.items()))
    here = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(parts, part).select("*", *((F.sum(c).over(here) + F.col(f"{name}_before")).alias(name) for name, c in own.items()))
    return joined.drop(*own.values(), *(f"{name}_before" for name in sums))


def _hasher(key: str, pieces: list[str], between: bytes, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hashes = None, []
        keys, out = [], [[] for _ in pieces]

        def ended() -> None:
            keys.append(current)
            for done, h in zip(out, hashes, strict=True):
                done.append(h.hexdigest())

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in pieces]
            for i, k in enumerate(batch.column(batch.schema.get_field_index(key)).to_pylist()):
                if not hashes or k != current:
                    if hashes:
                        ended()
                    current, hashes = k, [hashlib.sha256() for _ in pieces]
                elif between:
                    for h in hashes:
                        h.update(between)
                for h, column in zip(hashes, columns, strict=True):
                    h.update(column[i].as_py())
            if len(keys) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([keys, *out], schema.types, strict=True)], schema=schema)
                keys.clear()
                for done in out:
                    done.clear()
        if hashes:
            ended()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([keys, *out], schema.types, strict=True)], schema=schema)

    return run


def sequential_sha256(rows: DataFrame, key: str, order: list[str], pieces: list[str], between: bytes = b"") -> DataFrame:
    """For each key, the SHA-256 of each of the binary columns `pieces`, its values put one after the other by `order`.

    A SHA-256 can't be put together from parts, so the pieces of one key pass through one task, one at a time; callers
    join them into long pieces first.
    """
    kind = dict(rows.dtypes)[key]
    schema = pa.schema([(key, {"bigint": pa.int64(), "string": pa.string()}[kind]), *((c, pa.string()) for c in pieces)])
    ready = rows.select(key, *order, *pieces).repartition(key).sortWithinPartitions(key, *order)
    return ready.mapInArrow(_hasher(key, pieces, between, schema), f"{key} {kind}, " + ", ".join(f"{c} string" for c in pieces))
