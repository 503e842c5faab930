"""Approximate nearest neighbours by shifted Hilbert curves.

Each curve projects the vectors to `DIMS` random directions, takes the place of each projection among those of the fitted
vectors (so that a dense cluster fills as many cells as its share of the rows asks for, and no far vector widens the
cells), shifts them, and orders them along a Hilbert curve. Every
curve's order is cut into ranges of equal size; a query looks at its own range and those beside it, on every curve,
and the nearest found are merged and ranked by exact distances on the original vectors.

How much a query sees is a share of all rows (`SHARE` for each curve): vectors without near neighbours, as about half
of a random set in 64 dimensions are, show themselves to no smaller windows. Recall against brute force is measured in
the tests (0.9 or more); with well clustered vectors a smaller share does. A range is that share's third, so there are as
many ranges at any size, and their cuts stay few. The rows of a range are dealt into parts of `RANGE` about, and the queries
that look at it into parts of `QUERIES`; each two meet in a task of their own, whose size so doesn't grow with the table.

Equal vectors are indexed once: their rows with the smallest ids stand for them, and come back in the results.

What is fitted: `KNOTS` quantiles of each projection, on the `FIT_ROWS` distinct vectors of smallest digest. Ranges come from
quantiles over all vectors; those few numbers (40 a curve at the default share) are sent to every task.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id or
with another number of components than most of the fitted rows. Rows that repeat an id and its vector are one row. No
rows, or no queries, give no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import hot_join, written

CURVES = 16
DIMS = 8
BITS = 5
#: Share of all vectors in a query's window on one curve, ranges on either side of its own, and rows and queries that meet in a task.
SHARE = 0.075
REACH = 1
RANGE = 16_384
QUERIES = 4096
#: Rows below which a range isn't cut further: small tables (under 1,300 rows) see wider windows.
LEAST_RANGE = 32
FIT_ROWS = 4096
KNOTS = 513
TIE_BITS = 20
SEED = 11


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of integer points (rows), each coordinate below 2^bits; after Skilling."""
    x = points.T.astype(np.uint32)
    n = len(x)
    for level in range(bits - 1, 0, -1):
        top, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(n):
            invert = (x[i] & top) > 0
            swap = np.where(invert, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(invert, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[n - 1] & np.uint32(1 << level)) > 0, flip ^ np.uint32((1 << level) - 1), flip)
    x ^= flip
    keys = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for row in x:
            keys = (keys << 1) | ((row >> np.uint32(bit)) & np.uint32(1)).astype(np.int64)
    return keys


@lru_cache(maxsize=4)
def _directions(curves: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    dims = min(DIMS, width)
    return np.stack([np.linalg.qr(rng.normal(size=(width, dims)))[0] for _ in range(curves)]), rng.random((curves, dims))


def fitted_knots(fit: np.ndarray, curves: int) -> np.ndarray:
    """Quantiles of the projections of `fit`, by curve and direction."""
    projected = np.einsum("nw,cwd->cdn", fit, _directions(curves, fit.shape[1])[0])
    return np.moveaxis(np.quantile(projected, np.linspace(0, 1, KNOTS), axis=2), 0, 2)


def curve_keys(vectors: np.ndarray, ties: np.ndarray, curve: int, curves: int, knots: np.ndarray) -> np.ndarray:
    """Places of vectors on one curve; the tie bits, in another order on each curve, tell vectors in one cell apart."""
    directions, shifts = _directions(curves, vectors.shape[1])
    places = np.linspace(0, 1, knots.shape[2])
    ranks = np.stack([np.interp(x, at, places) for x, at in zip((vectors @ directions[curve]).T, knots[curve], strict=True)], axis=1)
    unit = (6 * ranks + shifts[curve] / 2) / 6.5
    cells = (np.clip(unit, 0, 1 - 1e-9) * (1 << BITS)).astype(np.int64)
    mixed = ((ties * (2 * curve + 1) * 0x9E3779B1) >> 12) & ((1 << TIE_BITS) - 1)
    return (hilbert_keys(cells) << TIE_BITS) | mixed


def _as_bytes(rows: DataFrame, kind: str) -> DataFrame:
    """(vec_id, digest, vec): each vector's bytes and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = [(np.asarray(x, kind) + np.asarray(0, kind)).tobytes() for x in batch.column(1).to_pylist()]
            digests = [hashlib.blake2b(v, digest_size=16).digest() for v in vecs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "digest", "vec"])

    return rows.mapInArrow(run, "vec_id long, digest binary, vec binary")


def nearest(rows: DataFrame, k: int = 10, query_every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = CURVES, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `query_every`, the k nearest others found."""
    kind = "<f4" if "float" in rows.schema[vec_col].dataType.simpleString() else "<f8"
    v = F.col(f"`{vec_col}`")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = rows.filter(F.col(f"`{id_col}`").isNotNull() & v.isNotNull()).filter(F.forall(v, finite) & F.exists(v, lambda x: x != 0))
    all_vecs = written(_as_bytes(valid.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v), kind), "vectors")
    out = "query_id long, rank int, vec_id long, score double"

    sample = [r[0] for r in all_vecs.dropDuplicates(["digest"]).orderBy("digest").select("vec").limit(FIT_ROWS).collect()]
    if not sample:
        return rows.sparkSession.createDataFrame([], out)
    widths = [len(x) for x in sample]
    width = max(sorted(set(widths)), key=widths.count)
    fit = np.stack([np.frombuffer(x, kind) for x in sample if len(x) == width]).astype(np.float64)
    knots = fitted_knots(fit, curves)

    by_id = Window.partitionBy("digest").orderBy("vec_id")
    members = all_vecs.filter(F.length("vec") == width).dropDuplicates(["digest", "vec_id"])
    members = written(members.withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= k + 1), "members")
    queries = all_vecs.filter((F.col("vec_id") % query_every == 0) & (F.length("vec") == width)).select(F.col("vec_id").alias("query_id"), F.col("digest").alias("q")).distinct()
    asked = queries.select("q").distinct()
    distinct = members.filter("nth = 1").join(asked, F.col("digest") == F.col("q"), "left").select("vec_id", "digest", "vec", F.col("q").isNotNull().alias("asked"))

    total = members.filter("nth = 1").count()
    size = max(LEAST_RANGE, int(total * share) // (2 * REACH + 1))
    ranges = max(1, -(-total // size))
    parts = -(-size // RANGE)
    asking = max(1, -(-asked.count() * (2 * REACH + 1) // (ranges * QUERIES)))

    def keys_of(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
        vecs = np.stack([np.frombuffer(x.as_py(), kind) for x in batch.column(at)]).astype(np.float64)
        ties = np.array([int.from_bytes(x.as_py()[:4], "little") for x in batch.column(at - 1)]) & ((1 << TIE_BITS) - 1)
        return vecs, ties

    def only_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vecs, ties = keys_of(batch, 1)
                for c in range(curves):
                    keys = curve_keys(vecs, ties, c, curves, knots)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys)], names=["curve", "key"])

    cuts = np.zeros((curves, 0), np.int64)
    if ranges > 1:
        quantiles = F.percentile_approx("key", [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges)).alias("cuts")
        found = distinct.select("digest", "vec").mapInArrow(only_keys, "curve int, key long").groupBy("curve").agg(quantiles).collect()
        cuts = np.array([r["cuts"] for r in sorted(found)])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs, ties = keys_of(batch, 2)
            is_query = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            mine, theirs = ties % parts, ties // 7 % asking
            for c in range(curves):
                own = np.searchsorted(cuts[c], curve_keys(vecs, ties, c, curves, knots), side="right")
                sends = [(np.arange(len(own)), own, mine, np.full(len(own), k), False) for k in range(asking)]
                for off in range(-REACH, REACH + 1):
                    asks = np.flatnonzero(is_query & (own + off >= 0) & (own + off < ranges))
                    sends += [(asks, own[asks] + off, np.full(len(asks), k), theirs[asks], True) for k in range(parts)]
                for rows_, at, part, ask, query in sends:
                    if len(rows_):
                        cell = ((c * ranges + at) * parts + (part if query else part[rows_])) * asking + ask
                        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(rows_), query)), *batch.take(pa.array(rows_)).columns[:3]], names=["cell", "query", "vec_id", "digest", "vec"])

    def ranked(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, base = pdf[pdf["query"]], pdf[~pdf["query"]]
        found = []
        if len(asks) and len(base):
            vecs = np.stack([np.frombuffer(x, kind) for x in base["vec"]]).astype(np.float64)
            ids, digests = base["vec_id"].to_numpy(), base["digest"].to_numpy()
            for q, vec in zip(asks["digest"], asks["vec"], strict=True):
                far = np.sqrt(((vecs - np.frombuffer(vec, kind).astype(np.float64)) ** 2).sum(axis=1))
                top = np.flatnonzero(far <= np.partition(far, k)[k]) if len(far) > k + 1 else np.arange(len(far))
                top = top[np.lexsort((ids[top], far[top]))][: k + 1]
                found += [(q, digests[i], ids[i], far[i]) for i in top]
        return pd.DataFrame(found, columns=["q", "digest", "first", "score"])

    near = distinct.select("vec_id", "digest", "vec", "asked").mapInArrow(dealt, "cell long, query boolean, vec_id long, digest binary, vec binary")
    found = near.groupBy("cell").applyInPandas(ranked, "q binary, digest binary, first long, score double").distinct()
    top = lambda part, *order: F.row_number().over(Window.partitionBy(part).orderBy(*order))
    found = found.withColumn("n", top("q", "score", "first")).filter(F.col("n") <= k + 1).select("q", "digest", "score")
    found = written(found, "found")
    # a vector near very many queries, and one that very many queries ask for, are hot keys
    ids = members.groupBy("digest").agg(F.collect_list("vec_id").alias("ids"))  # k + 1 at most
    met = written(found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).join(ids, "digest"), "found-ids")
    found = hot_join(found, met, "digest", "n", found.count()).select("q", "score", F.explode("ids").alias("vec_id"))
    found = found.withColumn("n", top("q", "score", "vec_id")).filter(F.col("n") <= k + 1)
    nearest_of = found.groupBy("q").agg(F.collect_list(F.struct("score", "vec_id")).alias("near"))  # k + 1 at most
    queries = written(queries, "queries")
    answers = written(queries.groupBy("q").agg(F.count(F.lit(1)).alias("n")).join(nearest_of, "q"), "answers")
    out_rows = hot_join(queries, answers, "q", "n", queries.count())
    others = F.slice(F.sort_array(F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))), 1, k)
    return out_rows.select("query_id", F.posexplode(others).alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
