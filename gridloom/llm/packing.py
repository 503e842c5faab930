"""Best-fit packing of documents into sequences, after a dominance reduction.

Texts become ids once, in tasks, and pieces of at most `capacity` tokens. All that decides the packing is how many
pieces have each length, and there are `capacity` lengths at most: that histogram is the instance, whatever the size
of the corpus, and it is solved on the driver.

1. Reduction after Martello and Toth. For the longest piece j, a set F that holds j is fixed for good if it dominates:
   if the other pieces of every feasible set with j fit, place by place, into those of F. Whole multiplicities are
   fixed at once. What is fixed leaves the instance, and the search starts again until nothing is fixed.
2. Best fit, longest first, for the rest.

The result is a list of patterns (how many sequences, which lengths in each). Every piece then gets its rank among the
pieces of its length, and the pattern's place for that rank; ranks come from windows over (length, bucket), buckets
being salt, so that a frequent length is many windows.

Cases: a null or empty text is its end id alone. Rows that repeat a doc_id are documents of their own. No rows give no
rows. Columns beside id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import written
from gridloom.llm.tokens import encoder as shared_encoder

CAPACITY = 1024
#: Pieces of a length that one window ranks, about.
WINDOW_ROWS = 500_000

Pattern = tuple[int, list[tuple[int, int]]]  # sequences, and (length, how many of it) in each


def _largest(count: list[int], most: int) -> int:
    """The largest length up to `most` that is there; 0 if none."""
    while most > 0 and not count[most]:
        most -= 1
    return max(most, 0)


def _smallest(count: list[int], k: int, above: int = 0) -> list[int]:
    """The k smallest pieces longer than `above`, with multiplicity, or all if there are fewer."""
    out: list[int] = []
    for x in range(above + 1, len(count)):
        out += [x] * min(count[x], k - len(out))
        if len(out) == k:
            break
    return out


def _best_pair(count: list[int], room: int) -> tuple[int, int] | None:
    """Two pieces (longer first) whose sum is the largest within `room`."""
    best, found = -1, None
    low, high = 1, min(room - 1, len(count) - 1)
    there = [x for x in range(low, high + 1) if count[x]]
    i, k = 0, len(there) - 1
    while i <= k:
        a, b = there[k], there[i]
        if a + b > room:
            k -= 1
            continue
        if (i < k or count[a] > 1) and a + b > best:
            best, found = a + b, (a, b)
        i += 1
    return found


def _dominating(count: list[int], j: int, capacity: int) -> list[int] | None:
    """Companions of a piece of length j (already taken from `count`) in a set that dominates all others, if one is found."""
    room = capacity - j
    three = _smallest(count, 3)
    if not three or three[0] > room:
        return []  # nothing fits beside j
    top = _largest(count, room)
    if top == room or len(three) < 2 or three[0] + three[1] > room:
        return [top]  # it fills the sequence, or one companion fits at most and this is the longest
    if len(three) == 3 and sum(three) <= room:
        return None  # three companions fit: left to best fit
    pair = _best_pair(count, room)
    if pair is None or top >= sum(pair):
        return [top]
    longer = _smallest(count, 2, pair[1])
    if pair[0] == top and (len(longer) < 2 or sum(longer) > room):
        return list(pair)  # no feasible pair has both pieces longer than the pair's shorter one
    return None


def reduce_instance(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], dict[int, int]]:
    """The dominating sets, fixed for good, and the histogram that is left."""
    count = [histogram.get(x, 0) for x in range(capacity + 1)]
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        for j in range(capacity, 0, -1):
            while count[j]:
                count[j] -= 1
                others = _dominating(count, j, capacity)
                count[j] += 1
                if others is None:
                    break
                need = {x: [j, *others].count(x) for x in {j, *others}}
                times = min(count[x] // k for x, k in need.items())
                for x, k in need.items():
                    count[x] -= times * k
                fixed.append((times, sorted(need.items(), reverse=True)))
                again = True
    return fixed, {x: n for x, n in enumerate(count) if n}


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best fit, longest first. Sequences that look alike are filled together."""
    open_: dict[int, list[Pattern]] = {}
    for length, n in sorted(histogram.items(), reverse=True):
        while n:
            room = min((r for r in open_ if r >= length), default=capacity)
            bins, items = open_[room].pop() if room in open_ else (n, [])
            if room in open_ and not open_[room]:
                del open_[room]
            each = room // length
            for sequences, k in ((min(bins, n // each), each), (1, n % each if n < bins * each else 0)):
                if sequences and k:
                    open_.setdefault(room - k * length, []).append((sequences, [*items, (length, k)]))
                    n, bins = n - sequences * k, bins - sequences
            if bins and items:
                open_.setdefault(room, []).append((bins, items))
    return [x for group in open_.values() for x in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = reduce_instance(histogram, capacity)
    return fixed + best_fit(left, capacity)


def _places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each pattern and length in it: the first rank it serves, its sequences, its first sequence and first offset."""
    rows, served, first = [], {}, 0
    for sequences, items in patterns:
        offset = 0
        for length, k in items:
            rank = served.get(length, 0)
            rows.append((length, rank, sequences, first, offset))
            served[length] = rank + sequences * k
            offset += length * k
        first += sequences
    rows.sort()
    names = ("length", "rank", "sequences", "first", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def pieces(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; only documents over `capacity` are cut, the first piece being the shorter."""
    names = ("doc_id", "piece", "start", "length", "ids_crc32")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = shared_encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                start, stop, piece = 0, n % capacity or capacity, 0
                while start < n:
                    out.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop, piece = stop, stop + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(5)], names=list(names))

    rows = docs.select(F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return rows.mapInArrow(cut, ", ".join(f"{x} long" for x in names))


def pack(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    lengths = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in lengths.collect()}  # `capacity` rows at most
    places = _places(plan(histogram, capacity))
    keys = (places["length"] << 44) + places["rank"]
    buckets = 16 + sum(histogram.values()) // WINDOW_ROWS
    salted = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(inside) - 1).join(begins, ["length", "bucket"])
    ranked = ranked.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", (F.col("begin") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            inner = rank - places["rank"][at]
            sequence = places["first"][at] + inner % places["sequences"][at]
            offset = places["offset"][at] + inner // places["sequences"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
