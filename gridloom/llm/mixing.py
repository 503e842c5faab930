"""Mixing sources to target weights by the cube method.

A source's documents are taken floor(r) times each, r being its target over its size, and once more with probability
r - floor(r), its inclusion probability. The cube method draws those last copies: it moves the probabilities along the null
space of the constraints "words taken" and "documents taken" until each is 0 or 1, so both totals stay what they were.
Every move goes one way or the other by a draw whose mean is no move at all, so each document's chance to be taken is
exactly its inclusion probability.

The flight runs in chunks of a source (documents dealt by a hash, so a hot source is many chunks). Documents of like size
fly together, from the largest down: beside two much smaller ones a large one hardly moves, and would be left. What such a
group leaves undecided, two at most, is moved against all smaller documents at once, as far as both totals allow. What
that leaves flies once more, and a chunk passes two documents on at most, mostly its smallest; they meet again in chunks of
chunks, until two documents at most are left for each source. They are the landing problem: the documents' total is given
up first, which decides one of them for the other, and the last one is drawn. Its size is the most by which a source's words
miss their target, and the documents' total is missed by less than two. Every draw is seeded: reruns agree.

Cases: a null or blank text has size 0 and is taken floor(r) or floor(r) + 1 times for 0 words. A null source is a
source, the last in order. Sources without a word have target 0. Rows with the same doc_id are documents of their own; in
`mixed`, rows that are equal in all columns share the copies of all of them. No rows give no rows. Very long texts are
counted whole. Further columns are ignored by `mix` and kept by `mixed`, under whatever names.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, place_of, plain_names, row_hashes, written

#: The weights of sources in order, repeating, and the most that a document is repeated.
WEIGHTS = (1, 2, 3)
MOST = 3
#: Documents in a chunk of the flight, and chunks whose undecided documents meet in the next round.
CHUNK = 2048
FAN_IN = 512
EPS = 1e-9


def word_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, size, n), a row for each n documents: source, source_size, docs, target, one row for each source.

    Water filling over one row a source: sources in order of the level at which they reach their cap; those whose cap
    lies below the level that the rest would get stop there, and the rest share what is left by weight.
    """
    total = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by_level = Window.orderBy("reach", "place").rowsBetween(Window.unboundedPreceding, -1)
    out = (
        total.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("reach", F.col("cap") / F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_level), F.lit(0.0)))
        .withColumn("shares", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)))
        .withColumn("capped", F.col("reach") <= F.col("rest") / F.col("shares"))
        .withColumn("level", F.min(F.when(~F.col("capped"), F.struct("reach", "place", (F.col("rest") / F.col("shares")).alias("l")))).over(every))
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("level.l"))
    return out.select("source", "source_size", "docs", target.alias("target"))


def _moved(p: list[float], at: list[int], u: list[float], rng: random.Random) -> None:
    """Move the probabilities at `at` along u, one way or the other, till one is 0 or 1; expectations stay."""
    up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(at, u, strict=True) if x)
    down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(at, u, strict=True) if x)
    move = up if rng.random() * (up + down) < down else -down
    for i, x in zip(at, u, strict=True):
        p[i] += move * x
        if p[i] < EPS or p[i] > 1 - EPS:
            p[i] = float(round(p[i]))


def flight(p: list[float], size: list[int], order: list[int], constraints: int, rng: random.Random) -> list[int]:
    """The flight phase over `order`, in place: keeps words, and documents too if `constraints` is 2.

    Returns the places left undecided, as many as there are constraints at most.
    """
    held: list[int] = []
    for i in order:
        if EPS < p[i] < 1 - EPS:
            held.append(i)
        else:
            p[i] = float(round(p[i]))
        if len(held) > constraints:
            x = [float(size[k]) for k in held]
            if constraints == 2:
                u = [x[1] - x[2], x[2] - x[0], x[0] - x[1]] if not x[0] == x[1] == x[2] else [1.0, -1.0, 0.0]
            else:
                u = [x[1], -x[0]] if any(x) else [1.0, -1.0]
            _moved(p, held, u, rng)
            held = [k for k in held if 0 < p[k] < 1]
    return held


def settle(p: list[float], size: list[int], i: int, rest: list[int], rng: random.Random, tries: int = 16) -> None:
    """Decide i by moving the probabilities of all of `rest` the other way, those far from 0 and 1 most, both totals in balance.

    Each try moves until i or one of the rest is decided; after `tries` i may be left.
    """
    rest = [k for k in rest if EPS < p[k] < 1 - EPS]
    for _ in range(tries):
        if len(rest) < 2 or not EPS < p[i] < 1 - EPS:
            return
        now, sizes = np.array([p[k] for k in rest]), np.array([size[k] for k in rest], float)
        room = now * (1 - now)
        n, once, twice = room.sum(), (room * sizes).sum(), (room * sizes * sizes).sum()
        spread = n * twice - once * once
        if spread <= 1e-6 * n * twice:
            return
        u = room * ((once * size[i] - twice) / spread + (once - n * size[i]) / spread * sizes)
        _moved(p, [i, *rest], [1.0, *u.tolist()], rng)
        rest = [k for k in rest if EPS < p[k] < 1 - EPS]


def decide(p: list[float], size: list[int], rng: random.Random) -> list[int]:
    """Decide all but two places at most; places are in descending order of size. Both totals stay."""
    rest = list(range(len(p)))
    while len(rest) > 2:
        alike = min(-(-len(rest) // 2), sum(2 * size[i] >= size[rest[0]] for i in rest))
        held, rest = flight(p, size, rest[:alike], 2, rng), rest[alike:]
        for i in held:
            settle(p, size, i, rest, rng)
    return flight(p, size, [i for i, x in enumerate(p) if EPS < x < 1 - EPS], 2, rng)


def land(p: list[float], size: list[int], left: list[int], rng: random.Random) -> None:
    """Decide the last places: one constraint less at a time, each move by a draw that keeps the probabilities."""
    for i in flight(p, size, left, 1, rng):
        p[i] = float(rng.random() < p[i])


def _run(pdf: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "doc_id", "h0", "h1", "nth"], ascending=[False, True, True, True, True], kind="stable")
    name = f"{seed}|{pdf['source'].iloc[0]}|{-1 if last else pdf['bucket'].iloc[0]}|{len(pdf)}"
    rng = random.Random(zlib.crc32(name.encode()))
    p, size = pdf["part"].tolist(), pdf["size"].tolist()
    held = decide(p, size, rng)
    if last:
        land(p, size, held, rng)
        held = []
    left = set(held)
    return pdf.assign(part=p, copies=[None if i in left else int(b) + round(x) for i, (b, x) in enumerate(zip(pdf["base"], p, strict=True))])


def _counted(n: Column, name: str) -> tuple[Column, Column]:
    """Two generators, one after the other, that together give n rows: neither makes a long array of a large n."""
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / 4096))).alias(f"{name}_block")
    inner = F.explode(F.sequence(F.col(f"{name}_block") * 4096, F.least(n - 1, F.col(f"{name}_block") * 4096 + 4095))).alias(name)
    return blocks, inner


def _times(rows: DataFrame, n: str, name: str) -> DataFrame:
    """Each row as often as its column `n` (1 or more) says, numbered from 0 in column `name`."""
    blocks, inner = _counted(F.col(n).cast("long"), name)
    return rows.select("*", blocks).select("*", inner).drop(f"{name}_block")


def _mixed_units(docs: DataFrame, hashes: list[Column], doc_id: Column, text: Column, source: Column, seed: int, chunk: int) -> DataFrame:
    """One row for each row of `docs`: doc_id, source, h0, h1, size, source_size, target, copies."""
    rows = docs.select(doc_id.alias("doc_id"), source.cast("string").alias("source"), hashes[0].alias("h0"), hashes[1].alias("h1"), word_count(text).alias("size"))
    # rows that repeat all of it are counted first: whichever of them is taken is no matter
    sizes = written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "sizes")
    targets = source_targets(sizes)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        _times(sizes, "n", "nth")
        .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("ratio", ratio)
        .withColumn("base", F.least(F.floor("ratio"), F.lit(MOST)).cast("int"))
        .withColumn("part", F.col("ratio") - F.col("base"))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h0", "nth"), F.ceil(F.col("docs") / chunk)))
        .select("doc_id", "source", "h0", "h1", "nth", "size", "source_size", "target", "base", "part", "bucket")
    )
    kinds = dict(units.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in units.columns) + ", copies int"
    flown = written(units.groupBy("source", "bucket").applyInPandas(lambda pdf: _run(pdf, seed, False), schema), "flight")
    done, left = [flown.filter("copies is not null")], flown.filter("copies is null")
    buckets = flown.agg(F.max("bucket")).first()[0] or 0
    while buckets >= FAN_IN:
        buckets //= FAN_IN
        left = left.drop("copies").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        flown = written(left.groupBy("source", "bucket").applyInPandas(lambda pdf: _run(pdf, seed, False), schema), "flight")
        done, left = [*done, flown.filter("copies is not null")], flown.filter("copies is null")
    landed = left.drop("copies").groupBy("source").applyInPandas(lambda pdf: _run(pdf, seed, True), schema)
    out = done[0]
    for x in [*done[1:], landed]:
        out = out.unionByName(x)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of `docs`: doc_id, source, size, source_size, target, copies, taken (copies times size)."""
    doc_id, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    out = _mixed_units(docs, [F.lit(0).cast("long")] * 2, doc_id, text, source, seed, chunk)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """`docs`, all columns, each row as often as the mix takes it. A row is known by hashes of all its columns; whole rows shuffle once."""
    named, names = plain_names(docs)
    doc_id, text, source = (F.col(place_of(docs, c)) for c in (id_col, text_col, source_col))
    hashes = row_hashes(named)
    units = _mixed_units(named, hashes, doc_id, text, source, seed, chunk)
    take = units.groupBy("h0", "h1").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    rows = named.select(hashes[0].alias("h0"), hashes[1].alias("h1"), F.struct(*names).alias("row")).groupBy("h0", "h1").agg(F.first("row").alias("row"))
    out = _times(rows.join(take, ["h0", "h1"]), "copies", "nth")
    return out.select(*(F.col(f"row.{c}").alias(c) for c in names)).toDF(*docs.columns)
