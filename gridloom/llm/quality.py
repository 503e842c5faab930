"""Quality classifier from weak labels.

1. Labellers. Overlapping heuristics vote on every whole text: bad, good, or nothing.
2. Label model. How often each combination of votes occurs in the corpus (3^labellers rows at most) is all that
   expectation-maximisation needs to estimate the labellers' accuracies and the share of good documents. Labellers are
   taken as independent given the class, a missing vote says nothing, and each kind of junk has labellers that overlap.
   One thing is known beforehand: a bad vote is rare on good documents (`RARE` at most). Each combination of votes gets
   its posterior.
3. Scorer. A linear model over hashed word shapes learns the posteriors of all documents: each of Newton's steps is a
   pass in which tasks add up slopes and curvatures of their rows, and Spark adds up those of the tasks, row by row of
   the matrix. Rows repeated with their ids are fitted on once. It scores every document; the score of a short text
   stays near the share of good ones. The cut lies below all but `LOSS` of the surely good documents, so that clean
   documents stay; counts of the scores' bits, 16 at a time, find it among all of them.

Texts go through Python once: votes and features (a few hundred bytes a document) are written together, and the scorer
reads those, once a step. `accepted` takes the rejected rows out natively: a Bloom filter of the rejected texts' hashes lets the others
pass where they are, and only those it doesn't shuffle.

No given label is used; held-out labels measure it in the tests.

Cases: a null or empty text has no votes and is kept: nothing speaks against it. Repeated rows are scored alike. No
rows give no rows. Very long texts are read whole. Columns beside id and text are ignored by `score`, and kept by
`accepted`, under whatever names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bloom
from gridloom.llm.common import place_of, plain_names, row_hashes, written
from gridloom.llm.tokens import let_go

#: Hashed features of the scorer.
FEATURES = 512
#: Weight that keeps the scorer's weights small: so much over RIDGE_DOCS documents, in proportion over more, and no less over fewer.
RIDGE, RIDGE_DOCS = 0.3, 10_000
#: Newton's steps end when no weight moves by so much, or after so many.
SETTLED, MOST_STEPS = 1e-4, 25
#: Documents whose features are held as an array at a time.
HELD = 1000
#: Share of the surely good documents that the cut may lose.
LOSS = 0.002
SURE = 0.95
#: Words of evidence that a document's score starts with, at the share of good documents: a few words alone decide little.
HABIT = 10
#: The most that a labeller's bad votes can be among its votes on good documents.
RARE = 0.002
MARKS = set(".!?")
STOPS = ".,;:!?"
#: Labellers: statistic, bounds of a bad vote (below, above), bounds of a good vote (from, to).
LABELLERS = (
    ("symbols", None, 0.15, 0.0, 0.02),
    ("repeats", None, 0.12, 0.0, 0.03),
    ("separators", None, 0.1, 0.0, 0.01),
    ("signs", None, 0.1, 0.0, 0.05),
    ("letters", 0.88, None, 0.9, 1.0),
    ("sentence", None, 60.0, 3.0, 30.0),
    ("capitals", None, 0.3, 0.0, 0.15),
    ("lines", None, 0.5, 0.0, 0.1),
    ("variety", 0.25, None, 0.5, 1.0),
)


def shape_of(word: str) -> str:
    """Letters as a or A, digits as 0, runs of one sign as one or two of it."""
    out: list[str] = []
    for c in word:
        k = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "l" if c.isalpha() else c
        if len(out) < 2 or out[-1] != k or out[-2] != k:
            if not (k in "aAl" and out and out[-1] == k):
                out.append(k)
    return "".join(out)


@lru_cache(maxsize=20_000)
def _hash(shape: str) -> int:
    return zlib.crc32(shape.encode())


class Reader:
    """Statistics and hashed features of texts; words met before are looked up."""

    def __init__(self, keep: int = 150_000):
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.empty((0, 8), np.int64)

    def _row(self, word: str) -> tuple[int, ...]:
        body = word.rstrip(STOPS)
        if body.isalpha() and (body.islower() or body.istitle()):  # most words: found faster
            stops, title = word[len(body) :], not body.islower()
            h = _hash(("A" if title else "") + "a" * (len(body) > title) + stops if len(stops) < 3 else shape_of(word))
            return len(word), len(body), int(title), int(any(a == b for a, b in zip(stops, stops[1:], strict=False))), 0, int(bool(stops) and stops[-1] in MARKS), h % FEATURES, h
        letters = sum(map(str.isalpha, word))
        upper = sum(map(str.isupper, word))
        signs = [c for c in word if not c.isalnum()]
        symbol = int(any(a == b for a, b in zip(signs, signs[1:], strict=False)) and letters > 0)
        separator = int(letters == 0 and not any(map(str.isdigit, word)))
        h = _hash(shape_of(word))
        return len(word), letters, upper, symbol, separator, int(bool(signs) and word[-1] in MARKS), h % FEATURES, h

    def _look(self, text: str) -> np.ndarray:
        words = text.split()
        if len(self.ids) > self.keep:
            self._forget()
        ids = self.ids
        at = list(map(ids.get, words))
        if None not in at:
            return np.array(at, np.int64)
        new = [w for w in set(words) if w not in ids]
        first = len(ids)
        if first + len(new) > len(self.table):
            grown = np.zeros((max(1024, 2 * len(self.table), first + len(new)), 8), np.int64)
            grown[: len(self.table)] = self.table
            self.table = grown
        self.table[first : first + len(new)] = [self._row(w) for w in new]
        ids.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))

    def statistics(self, text: str, at: np.ndarray) -> dict[str, float]:
        """Statistics of a text from its words' rows."""
        n = len(at)
        if not n:
            return {}
        chars, letters, upper, symbol, separator, end = self.table[at, :6].sum(axis=0).tolist()
        lines = text.split("\n")
        out = {"symbols": symbol / n, "separators": separator / n, "capitals": upper / max(1, letters)}
        if n >= 5:
            out["repeats"] = float((at[1:] == at[:-1]).mean())
            out["signs"] = float(self.table[at, 3:5].any(axis=1).mean())
        if n >= 12:
            out["letters"] = letters / chars
        if n >= 20:
            out["variety"] = len(np.unique(at[:2000])) / min(n, 2000) if n <= 2000 else float(np.mean([len(np.unique(at[k : k + 2000])) / len(at[k : k + 2000]) for k in range(0, n, 2000)]))
            out["sentence"] = n / max(end, 0.5)
        if len(lines) >= 4:
            out["lines"] = 1 - len(set(lines)) / len(lines)
        return out

    def __call__(self, text: str) -> tuple[int, bytes, int]:
        """Votes, features and number of words."""
        at = self._look(text)
        return self.votes(text, at), self.features(at), len(at)

    def votes(self, text: str, at: np.ndarray) -> int:
        """All votes as one number in base 3: 0 none, 1 bad, 2 good; the first labeller last."""
        stats, out = self.statistics(text, at), 0
        for name, below, above, low, high in reversed(LABELLERS):
            x = stats.get(name)
            vote = 0
            if x is not None:
                bad = below is not None and x < below or above is not None and x > above
                vote = 1 if bad else 2 if low <= x <= high else 0
            out = 3 * out + vote
        return out

    def features(self, at: np.ndarray) -> bytes:
        """How often each word shape and each pair of neighbours occurs, hashed; repeats count as a shape."""
        if not len(at):
            return b""
        h = self.table[at, 7]
        pairs = np.where(at[1:] == at[:-1], 1, (h[:-1] * 31 + h[1:]) >> 3) % FEATURES
        x = np.bincount(self.table[at, 6], minlength=FEATURES) + np.bincount(pairs, minlength=FEATURES)
        there = np.flatnonzero(x)
        return there.astype("<u2").tobytes() + x[there].astype("<u4").tobytes()


def dense(packed: list[bytes], n: np.ndarray) -> np.ndarray:
    """Feature vectors, a row a document: square roots of the shares."""
    out = np.zeros((len(packed), FEATURES), np.float32)
    for row, x in zip(out, packed, strict=True):
        k = len(x) // 6
        row[np.frombuffer(x, "<u2", k)] = np.frombuffer(x, "<u4", k, 2 * k)
    return np.sqrt(out / np.maximum(2 * n, 1)[:, None])


def _unpack(patterns: np.ndarray) -> np.ndarray:
    """Votes, a row for each pattern and a column for each labeller."""
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """By EM: each pattern's posterior of being good, each labeller's share of bad votes given (bad, good), the share of good.

    It starts from a majority in which a bad vote weighs more; counts are smoothed by two documents.
    """
    votes = _unpack(patterns)
    bad, cast = (votes == 1).astype(float), (votes > 0).astype(float)
    good = 1 / (1 + np.exp(2.0 * bad.sum(axis=1) - 0.5 * (cast - bad).sum(axis=1)))
    for _ in range(rounds):
        before = good
        chance = np.stack([((counts * w) @ bad + 1) / ((counts * w) @ cast + 2) for w in (1 - good, good)])
        chance[1] = np.minimum(chance[1], RARE)
        chance = np.clip(chance, 1e-6, 1 - 1e-6)
        share = (counts @ good + 1) / (counts.sum() + 2)
        like = [np.log(s) + bad @ np.log(c) + (cast - bad) @ np.log(1 - c) for s, c in zip((1 - share, share), chance, strict=True)]
        good = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        if np.abs(good - before).max() < 1e-9:
            break
    return good, chance, float(share)


def chance(x: np.ndarray, n: np.ndarray, w: np.ndarray, share: float) -> np.ndarray:
    """Chance of being good, from features, numbers of words, weights and the share of good documents."""
    start, trust = np.log(share / (1 - share)), n / (n + HABIT)
    logit = start + trust * (np.clip(x @ w[:-1] + w[-1], -30, 30) - start)
    return 1 / (1 + np.exp(-logit))


def _read(rows: DataFrame) -> DataFrame:
    """A written table of `rows` (some columns, then h, then text) with votes (pattern), features (x) and words (n) in place of the text."""
    passed = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        read = Reader()  # of this task: a worker that goes on to another stage keeps none of it
        for batch in batches:
            got = [read(x.as_py()) for x in batch.column(len(passed))]
            cols = [pa.array([v for v, _, _ in got], pa.int32()), pa.array([x for _, x, _ in got], pa.binary()), pa.array([n for _, _, n in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], *cols], names=[*passed, "pattern", "x", "n"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in passed)
    return written(rows.mapInArrow(run, f"{kinds}, pattern int, x binary, n long"), "votes")


def _numbers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, numbers of words and patterns of a batch that ends in x, n and pattern, HELD rows at a time."""
    for k in range(0, batch.num_rows, HELD):
        x, n, pattern = batch.slice(k, HELD).columns[-3:]
        yield dense(x.to_pylist(), n.to_numpy()), n.to_numpy(), pattern.to_numpy()


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Curvature (without the ridge) of the loss at weights w, a row a weight, and then its slope."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    slope = x.T @ (p - y)
    x *= np.sqrt(p * (1 - p))[:, None]
    return np.vstack([x.T @ x, slope])


def _curve_of_all(rows: DataFrame, patterns: np.ndarray, good: np.ndarray, w: np.ndarray) -> np.ndarray:
    """As `_curve`, over a table of x, n and pattern: tasks add up their rows, then Spark adds up those sums, each row of the matrix by itself."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = np.zeros((FEATURES + 2, FEATURES + 1))
        for batch in batches:
            for x, _, pattern in _numbers(batch):
                total += _curve(x, good[np.searchsorted(patterns, pattern)], w)
        at, task = np.arange(len(total), dtype=np.int32), np.full(len(total), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(task), pa.array([v.tobytes() for v in total], pa.binary())], names=["at", "task", "v"])

    def added(sums: pa.Table) -> pa.Table:
        sums = sums.sort_by("task")  # the total doesn't depend on which task ended first
        v = np.sum([np.frombuffer(x) for x in sums["v"].to_pylist()], axis=0)
        return pa.table({"at": sums["at"][:1], "v": pa.array([v.tobytes()], pa.binary())})

    parts = rows.select("x", "n", "pattern").mapInArrow(of_task, "at int, task int, v binary")
    got = parts.groupBy("at").applyInArrow(added, "at int, v binary").collect()  # FEATURES + 2 rows
    return np.stack([np.frombuffer(r["v"]) for r in sorted(got, key=lambda r: r["at"])])


def _newton(curve: Callable[[np.ndarray], np.ndarray], features: int, docs: int) -> np.ndarray:
    """Logistic weights for soft labels, by Newton's method; the last is the bias."""
    w = np.zeros(features + 1)
    keep = np.full(len(w), RIDGE * max(1.0, docs / RIDGE_DOCS))
    keep[-1] = 1e-6
    for _ in range(MOST_STEPS):
        got = curve(w)
        step = np.linalg.solve(got[:-1] + np.diag(keep), got[-1] + keep * w)
        w = w - step
        if np.abs(step).max() < SETTLED:
            break
    return w


def _linear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The weights for documents in memory."""
    return _newton(lambda w: _curve(x, y, w), x.shape[1], len(x))


def nth(keys: DataFrame, n: int) -> int:
    """The n-th smallest (from 0) of the column `key`, non-negative longs: by counts of their first 16 bits, then of the next, among those that agree so far."""
    found = 0
    for shift in (48, 32, 16, 0):
        if shift < 48:
            keys = keys.filter(F.shiftright("key", shift + 16) == found)
        for found, count in sorted(tuple(r) for r in keys.groupBy(F.shiftright("key", shift)).count().collect()):  # noqa: B007 - 65,536 rows at most
            if n < count:
                break
            n -= count
    return found


def quantile(keys: DataFrame, share: float) -> float | None:
    """The quantile of positive doubles, whose bits are the column `key`, between its neighbours in proportion as numpy has it; None of no rows."""
    total = keys.count()
    if not total:
        return None
    n, part = int(share * (total - 1)), share * (total - 1) % 1
    low = nth(keys, n)
    up_to, above = keys.agg(F.count_if(F.col("key") <= low), F.min(F.when(F.col("key") > low, F.col("key")))).first()
    high = low if up_to > n + 1 or above is None else above
    low, high = np.array([low, high]).view(np.float64)
    return float(low + part * (high - low))


def fitted(voted: DataFrame) -> tuple[np.ndarray, float, float] | None:
    """The scorer's weights, the share of good documents, and the cut; None without documents of both kinds."""
    table = sorted(tuple(r) for r in voted.groupBy("pattern").count().collect())  # 3^labellers rows at most
    if not table:
        return None
    patterns, counts = np.array(table, np.int64).T
    good, _, share = label_model(patterns, counts.astype(float))
    if good.min() > 0.5 or good.max() < 0.5:
        return None
    # the hash goes along with each row, so an id that is missing or repeated is no matter
    rows = written(voted.select("h", "x", "n", "pattern").dropDuplicates(["h"]), "distinct")
    w = _newton(lambda w: _curve_of_all(rows, patterns, good, w), FEATURES, rows.count())

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, n, _ in _numbers(batch):
                yield pa.RecordBatch.from_arrays([pa.array(chance(x, n, w, share).view(np.int64))], names=["key"])

    surely = [int(p) for p, y in zip(patterns, good, strict=True) if y > SURE]
    sure = written(rows.join(F.broadcast(voted.sparkSession.createDataFrame([(p,) for p in surely], "pattern int")), "pattern", "left_semi").select("x", "n", "pattern").mapInArrow(keyed, "key long"), "sure")
    cut = quantile(sure, LOSS)
    return w, share, 0.5 if cut is None else min(0.5, cut)


def _scored(voted: DataFrame, passed: list[str]) -> DataFrame:
    """The columns `passed` of a table of votes and features, with score and accepted."""
    model = fitted(voted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.ones(batch.num_rows)
            if model is not None and batch.num_rows:
                score = np.concatenate([chance(x, n, *model[:2]) for x, n, _ in _numbers(batch)])
            accepted = score >= (model[2] if model is not None else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=[*passed, "score", "accepted"])

    kinds = ", ".join(f"{c} {voted.schema[c].dataType.simpleString()}" for c in passed)
    return voted.select(*passed, "x", "n", "pattern").mapInArrow(run, f"{kinds}, score double, accepted boolean")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, score (chance of being good), accepted."""
    doc_id, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return _scored(_read(docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("h"), text.alias("text"))), ["doc_id"])


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that the classifier accepts."""
    rows, names = plain_names(docs)
    doc_id, text = F.col(place_of(docs, id_col)), F.coalesce(F.col(place_of(docs, text_col)), F.lit(""))
    rows = rows.withColumns(dict(zip(("t0", "t1"), row_hashes(rows, [place_of(docs, text_col)]), strict=True)))
    voted = _read(rows.select("t0", "t1", F.xxhash64(doc_id, text).alias("h"), text.alias("text")))
    rejected = written(_scored(voted, ["t0", "t1"]).filter("NOT accepted").select("t0", "t1").distinct(), "rejected")
    slots = bloom.slots_for(rejected.count())
    straight, maybe = bloom.parted(rows, written(bloom.marks(rejected.select(F.col("t0").alias("h")), slots), "marks"), "t0", slots)
    return straight.unionByName(maybe.join(rejected, ["t0", "t1"], "left_anti")).select(*names).toDF(*docs.columns)
