"""Toxicity: a learnt lexicon, matched through misspellings, scored by the context of each match.

1. Lexicon. From a bounded sample of labelled rows (`FIT_DOCS` ids of smallest hash, one text of `FIT_CHARS` characters at most each) all
   words and word beginnings that stand in toxic documents significantly more often than elsewhere. A term's support is the number of
   different neighbourhoods that it stands in, so a copied document speaks once. What this gathers is bounded by the sample.
2. Matching. The lexicon is a trie. Its product with the Levenshtein automaton of one edit is a deterministic automaton
   that is built as words walk it, and dies on most words after a few letters. Words and beginnings are walked alike: a
   word ends where the token ends, a beginning anywhere in it, and each match has its number of edits. Terms may be misspelled if they
   have `FUZZY_FROM` letters (beginnings: `FUZZY_BEGINNING`) and if what lies one edit from them is rare in clean rows of the sample: a term
   with ordinary words next to it, by the sample, is matched exactly only. Tokens that the sample's clean rows use are no misspellings.
3. Context. Every match has a window: whether it is quoted, and how near a verb of saying, a word for the person spoken to and
   a negation stand. A logistic model of the label over these patterns, counted over the sample, gives each match its score: 1
   without context, less for a quotation, more for abuse at someone. Few examples leave its weights where they began.
4. A logistic model over the scored sums of exact and of misspelled matches, their density and the text's length, fitted on the same
   sample. The weight of misspellings is then fitted alone on copies of the sample's rows in which one letter of each match is
   changed, so that it is learnt from misspellings; it is never below 0.

Labels are the only other input: neither language, source nor id reaches a score. Every whole text is scored.

Cases: a null or empty text is scored as a text without a match. Rows that repeat an id are scored each by its own text,
and the least of their texts is fitted on; an id with several labels is toxic if one says so. Without labels of both
kinds the lexicon is empty and the score is the share of toxic labels. Very long texts and words are read whole. No rows give no
rows. Columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BATCH_ROWS, small_batches, written

#: Labelled documents that the lexicon and the model are fitted on at most, and the longest text among them.
FIT_DOCS = 20_000
FIT_CHARS = 100_000
#: Least support of a term, least documents, and letters from which a word and a beginning may be misspelled.
LEAST_SUPPORT = 4
LEAST_DOCS = 3
FUZZY_FROM = 5
FUZZY_BEGINNING = 7
#: A term may be misspelled if at most this share of clean rows, or a third of the share of toxic rows, hold a token one edit from it.
STRAY = 0.001
#: Lengths of word beginnings that are looked at, and the cut of the predicted label.
BEGINNINGS = (5, 6, 7, 8)
CUT = 0.3
#: Characters of context on each side of a match, and words within which a word of the window is near. Letters of tokens that are remembered.
CONTEXT = 80
NEAR_WORDS = 4
KEPT_LETTERS = 40
TOKEN = re.compile(r"\w+(?:[*@$!]\w+)*")
#: Quotation marks that open and that close, and the mark of a quoted line.
OPEN_MARKS, CLOSE_MARKS, QUOTED_LINE = "\"\u201c\u201e\u00ab\u2039\u2018", "\"\u201d\u201c\u00bb\u203a\u2019", ">"
#: Verbs of saying, words for the person spoken to, and negations, in English, German, French and Spanish.
SAYING = frozenset("say says said saying call calls called calling quote quotes quoted write writes wrote written tell tells told shout shouts shouted yell yelled word words term sagt sagte sagen nannte schrieb rief wort dit disait appelle mot dice dijo llama palabra".split())
ADDRESSED = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes eres ti".split())
NEGATED = frozenset("not no never nor without don't dont isn't isnt nicht kein keine nie ne pas jamais sans nunca sin".split())
WINDOW_WORDS = (SAYING, ADDRESSED, NEGATED)
#: What the fits begin from: quoted, saying, addressed, negated; and bias, exact, misspelled, density, length.
CONTEXT_PRIOR = np.array([-2.5, -0.7, 0.7, -0.4])
PRIOR = np.array([-4.0, 3.0, 2.5, 0.0, 0.0])
#: Tokens from which a text counts as long: long ones match by chance more often.
LENGTH = 500
#: Weights that may not fall below 0.
FLOORED = (1, 2)
MISSPELLED = 2
#: Patterns of a window: quoted or not, and for each kind of word absent, in the window, or near.
PATTERNS = 2 * 3**3
#: Rows of terms that a task hands on at once.
ROWS_AT_ONCE = 20_000


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from fitting: crc32 of its id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Matcher:
    """The lexicon trie and the automaton of one edit, walked together; a state is a set of (node, edits).

    `fuzzy` are the terms (beginnings with a final *) that may be misspelled; all that are long enough, if None.
    """

    def __init__(self, words: list[str], beginnings: list[str], fuzzy: frozenset[str] | None = None, keep: int = 200_000):
        self.next: list[dict[str, int]] = [{}]
        self.word, self.begins = [False], [False]
        self.word_near, self.begins_near = [""], [""]  # the term, where it may be misspelled
        for terms, marks, near, least, tail in ((words, self.word, self.word_near, FUZZY_FROM, ""), (beginnings, self.begins, self.begins_near, FUZZY_BEGINNING, "*")):
            for term in terms:
                node = 0
                for c in term:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        self.word.append(False)
                        self.begins.append(False)
                        self.word_near.append("")
                        self.begins_near.append("")
                    node = self.next[node][c]
                marks[node] = True
                if len(term) >= least and (fuzzy is None or term + tail in fuzzy):
                    near[node] = term + tail
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.start = self._id({(0, 0), *((n, 1) for n in self.next[0].values())})

    def _id(self, states: set) -> int:
        key = frozenset(states)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.sets[state]:
            if (child := self.next[node].get(c)) is not None:
                out.add((child, edits))
                if not edits:
                    out.update((n, 1) for n in self.next[child].values())  # a letter of the term left out
            if not edits:
                out.add((node, 1))  # a letter too many
                out.update((n, 1) for n in self.next[node].values())  # another letter
        return self._id(out)

    def terms(self, token: str) -> tuple[bool, set[str]]:
        """Whether a token matches without an edit, and the terms that it matches with one."""
        if len(self.moves) > self.keep:
            self._forget()
        state, near = self.start, set()
        for c in token:
            to = self.moves.get((state, c))
            if to is None:
                to = self.moves[state, c] = self._move(state, c)
            state, states = to, self.sets[to]
            if not states:
                return False, near
            for n, edits in states:
                if self.begins[n]:
                    if not edits:
                        return True, near
                    if self.begins_near[n]:
                        near.add(self.begins_near[n])
        states = self.sets[state]
        if any(not e and self.word[n] for n, e in states):
            return True, near
        near.update(self.word_near[n] for n, _ in states if self.word_near[n])
        return False, near

    def __call__(self, token: str) -> int:
        """0: no match; 1: exact; 2: one edit away."""
        exact, near = self.terms(token)
        return 1 if exact else 2 if near else 0


def quoted(text: str, begin: int, end: int) -> bool:
    """Whether a match stands in quotation marks that open and close near it, or in a quoted line."""
    line = text.rfind("\n", 0, begin) + 1
    if text[line : line + 1] == QUOTED_LINE:
        return True
    before, after = text[max(line, begin - CONTEXT) : begin], text[end : end + CONTEXT].split("\n", 1)[0]
    opened = max(before.rfind(c) for c in OPEN_MARKS)
    if opened < 0 or (before[opened] == '"' and before.count('"') % 2 == 0):
        return False
    inside = before[opened + 1 :]
    return not any(c in inside for c in CLOSE_MARKS if c not in OPEN_MARKS or c == before[opened]) and any(c in after for c in CLOSE_MARKS)


def pattern(text: str, begin: int, end: int) -> int:
    """The number of a match's window."""
    line = max(text.rfind("\n", 0, begin) + 1, begin - CONTEXT)
    before, after = TOKEN.findall(text[line:begin]), TOKEN.findall(text[end : end + CONTEXT].split("\n", 1)[0])
    out = int(quoted(text, begin, end))
    for kind in WINDOW_WORDS:
        far = min((i for words in (before[::-1], after) for i, w in enumerate(words) if w in kind), default=None)
        out = 3 * out + (0 if far is None else 2 if far < NEAR_WORDS else 1)
    return out


def pattern_features(p: int) -> list[float]:
    """Quoted, saying, addressed, negated: 1 where a word is near, a half where it is in the window."""
    levels = []
    for _ in WINDOW_WORDS:
        p, level = divmod(p, 3)
        levels.append(level / 2)
    return [float(p), *levels[::-1]]


def match_scores(weights: np.ndarray) -> np.ndarray:
    """The score of a match for each pattern of its window: 1 without context, between 0 and 2."""
    x = np.array([pattern_features(p) for p in range(PATTERNS)])
    return 2 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


class Reader:
    """Matches of texts, with the patterns of their windows.

    `ordinary` are hashes of tokens that are no misspellings.
    """

    def __init__(self, words: list[str], beginnings: list[str], fuzzy: frozenset[str] | None = None, ordinary: frozenset[int] = frozenset(), keep: int = 200_000):
        self.match, self.ordinary, self.keep = Matcher(words, beginnings, fuzzy), ordinary, keep
        self.clean: set[str] = set()
        self.hits: dict[str, int] = {}

    def kind(self, token: str) -> int:
        """0: no match; 1: exact; 2: misspelled."""
        kind = self.match(token)
        return 0 if kind == 2 and token_hash(token) in self.ordinary else kind

    def matches(self, text: str) -> tuple[list[tuple[int, int, int, int]], int]:
        """(kind, pattern, begin, end) of each match in a text of lower case, and the number of tokens."""
        tokens = TOKEN.findall(text)
        hits = {}
        for t in set(tokens) - self.clean:
            kind = self.hits.get(t)
            if kind is None:
                kind = self.kind(t)
                if len(t) <= KEPT_LETTERS:
                    if kind:
                        self.hits[t] = kind
                    else:
                        self.clean.add(t)
            if kind:
                hits[t] = kind
        for kept in (self.clean, self.hits):
            if len(kept) > self.keep:
                kept.clear()
        if not hits:
            return [], len(tokens)
        return [(hits[m[0]], pattern(text, m.start(), m.end()), m.start(), m.end()) for m in TOKEN.finditer(text) if m[0] in hits], len(tokens)

    def features(self, text: str, scores: np.ndarray) -> list[float]:
        """Bias, logarithms of the scored sums of exact and misspelled matches, their density, and length; then counts of exact, misspelled and quoted matches."""
        return summed(*self.matches(text.lower()), scores)


def summed(found: list[tuple[int, int, int, int]], tokens: int, scores: np.ndarray) -> list[float]:
    sums, counts = [0.0, 0.0], [0, 0, 0]
    for kind, at, _, _ in found:
        sums[kind - 1] += scores[at]
        counts[kind - 1] += 1
        counts[2] += at >= PATTERNS // 2
    return [1.0, log(1 + sums[0]), log(1 + sums[1]), 10 * sum(sums) / max(1, tokens), log(1 + tokens / LENGTH), *counts]


def token_hash(token: str) -> int:
    return zlib.crc32(token.encode()) << 16 | zlib.adler32(token[::-1].encode()) & 0xFFFF


def misspelt(word: str, rng: np.random.Generator) -> str:
    """A word with one letter left out, doubled or changed, not the first."""
    at, how = int(rng.integers(1, max(2, len(word)))), int(rng.integers(3))
    if len(word) < 2:
        return word
    return word[:at] + ("" if how == 0 else word[at] * 2 if how == 1 else "aeiounrst"[int(rng.integers(9))]) + word[at + 1 :]


def with_misspellings(read: Reader, text: str, rng: np.random.Generator) -> str | None:
    """A text in lower case with a letter of each exact match changed; None if no match can be found misspelled."""
    found = [m for m in read.matches(text)[0] if m[0] == 1]
    out, last = [], 0
    for _, _, begin, end in found:
        out += [text[last:begin], misspelt(text[begin:end], rng)]
        last = end
    changed = "".join(out) + text[last:]
    return changed if any(kind == 2 for kind, *_ in read.matches(changed)[0]) else None


def _terms_of(text: str) -> Iterator[tuple[str, int]]:
    """(term, neighbourhood): words, and beginnings marked by a final *, with a hash of the words beside them."""
    tokens = TOKEN.findall(text.lower())
    for before, t, after in zip(["", *tokens], tokens, [*tokens[1:], ""], strict=False):
        near = zlib.crc32(f"{before} {after}".encode())
        yield t, near
        for k in BEGINNINGS:
            if len(t) > k:
                yield t[:k] + "*", near


def _term_rows(docs: DataFrame, only: set[str] | None) -> DataFrame:
    """(term, near, doc) of each document; only the terms in `only`, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: list[str] = []
        nears: list[int] = []
        docs_: list[int] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(nears, pa.int64()), pa.array(docs_, pa.int64())], names=["term", "near", "doc"])
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                places: dict[str, set[int]] = {}
                for t, near in _terms_of(text.as_py()):
                    if only is None or t in only:
                        places.setdefault(t, set()).add(near)
                for t, at in places.items():
                    terms += [t] * len(at)
                    nears += at
                docs_ += [doc.as_py()] * (len(terms) - len(docs_))
                if len(terms) >= ROWS_AT_ONCE:
                    yield made()
                    terms, nears, docs_ = [], [], []
        yield made()

    return docs.select("doc", "text").mapInArrow(run, "term string, near long, doc long")


def _tail(hits: int, n: int, share: float) -> float:
    """Logarithm of an upper bound on the chance of `hits` or more out of n, each with chance `share`."""
    if hits <= n * share:
        return 0.0
    each = lgamma(n + 1) - lgamma(hits + 1) - lgamma(n - hits + 1) + hits * log(share) + (n - hits) * log(1 - share)
    return min(0.0, each + log(n - hits + 1))


def learn_lexicon(fit: DataFrame) -> tuple[list[str], list[str]]:
    """Words and beginnings that mark toxic rows of `fit` (doc, text, toxic)."""
    sizes = {r["toxic"]: r["n"] for r in fit.groupBy("toxic").agg(F.sum(F.length("text")).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return [], []
    share = sizes[1] / (sizes[0] + sizes[1])
    rows = _term_rows(fit.filter("toxic = 1"), None).groupBy("term").agg(F.count_distinct("near").alias("hits"), F.count_distinct("doc").alias("docs"))
    found = rows.filter((F.col("hits") >= LEAST_SUPPORT) & (F.col("docs") >= LEAST_DOCS)).collect()  # terms of FIT_DOCS documents at most
    hits = {r["term"]: r["hits"] for r in found}
    only = set(hits)
    other = _term_rows(fit.filter("toxic = 0"), only).groupBy("term").agg(F.count_distinct("near").alias("n"))
    misses = {r["term"]: r["n"] for r in other.collect()}  # of `only`
    sure = log(0.01 / max(1, len(hits)))
    scored = sorted((t for t in hits if misses.get(t, 0) * 4 < hits[t] and _tail(hits[t], hits[t] + misses.get(t, 0), share) < sure), key=lambda t: (-hits[t], t))
    return [t for t in scored if t[-1] != "*"], [t[:-1] for t in scored if t[-1] == "*"]


def strays(fit: DataFrame, words: list[str], beginnings: list[str]) -> tuple[frozenset[str], frozenset[int]]:
    """Which terms may be misspelled, and hashes of the tokens one edit from them that are ordinary: both by the rows of `fit`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(words, beginnings)
        for batch in batches:
            out = []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen: dict[tuple[str, int], None] = {}
                for t in set(TOKEN.findall(text.lower())):
                    exact, near = match.terms(t)
                    if not exact and near:
                        seen.update(dict.fromkeys((term, -1) for term in near))
                        if not toxic:
                            seen["", token_hash(t)] = None
                out += [(toxic, term, h) for term, h in seen]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.string(), pa.int64()), strict=True)], names=["toxic", "term", "h"])

    found = written(fit.select("toxic", "text").mapInArrow(run, "toxic int, term string, h long").groupBy("toxic", "term", "h").agg(F.count(F.lit(1)).alias("n")), "toxicity-strays")
    rows = {r["toxic"]: r["n"] for r in fit.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {(r["term"], r["toxic"]): r["n"] / rows[r["toxic"]] for r in found.filter("h = -1").collect()}  # two rows a term at most
    fuzzy = frozenset(t for t in (*words, *(b + "*" for b in beginnings)) if share.get((t, 0), 0.0) <= max(STRAY, share.get((t, 1), 0.0) / 3))
    return fuzzy, frozenset(r["h"] for r in found.filter("h <> -1").collect())  # tokens near a term, of clean rows of the sample


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, weight: np.ndarray | None = None, floored: tuple[int, ...] = (), free: tuple[int, ...] | None = None, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton's method, drawn to `prior`; those of `floored` at 0 or more, and those that aren't `free` as in `prior`."""
    free, w = np.isin(np.arange(len(prior)), np.arange(len(prior)) if free is None else free), prior.copy()
    n = np.ones(len(y)) if weight is None else weight
    while True:
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            gradient = x.T @ (n * (p - y)) + ridge * (w - prior)
            step = np.zeros(len(w))
            step[free] = np.linalg.solve(hessian[np.ix_(free, free)], gradient[free])
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        low = [i for i in floored if w[i] < 0]
        if not low:
            return w
        free[low], w[low] = False, 0.0


def context_weights(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """Weights of the window's features from (pattern, toxic, matches). The bias, free, is left out."""
    x = np.array([[1.0, *pattern_features(p)] for p, _, _ in counts]).reshape(-1, 1 + len(CONTEXT_PRIOR))
    y, n = (np.array([c[i] for c in counts], float) for i in (1, 2))
    return _logistic(x, y, np.concatenate([[0.0], CONTEXT_PRIOR]), n)[1:] if len(counts) else CONTEXT_PRIOR


def fit_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int = FIT_DOCS) -> DataFrame:
    """(doc, text, toxic) of the labelled rows that are fitted on, at most `most` ids."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("doc")).agg(F.max(label_col).cast("int").alias("toxic")).orderBy(F.xxhash64("doc"), "doc").limit(most)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).filter(F.length("text") <= FIT_CHARS)
    fit = rows.join(F.broadcast(known), "doc")  # `most` pairs of numbers
    return written(fit.groupBy("doc").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "toxicity-fit")


def fitted(fit: DataFrame) -> tuple[list[str], list[str], frozenset[str], frozenset[int], np.ndarray, np.ndarray]:
    """Words, beginnings, terms that may be misspelled, tokens that are no misspellings, scores of windows, and weights: from (doc, text, toxic)."""
    words, beginnings = learn_lexicon(fit)
    fuzzy, ordinary = strays(fit, words, beginnings)
    reader = lambda: Reader(words, beginnings, fuzzy, ordinary)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for batch in batches:
            found = [(at, toxic) for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for _, at, _, _ in read.matches(text.lower())[0]]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int32()) for i in (0, 1)], names=["pattern", "toxic"])

    counted = fit.select("toxic", "text").mapInArrow(windows, "pattern int, toxic int").groupBy("pattern", "toxic").agg(F.count(F.lit(1)).alias("n"))
    scores = match_scores(context_weights([tuple(r) for r in counted.collect()]))  # two rows a pattern at most

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for batch in batches:
            keys, changed, x = [], [], []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = text.lower()
                for version in (low, with_misspellings(read, low, np.random.default_rng(zlib.crc32(low.encode())))):
                    if version is not None:
                        keys.append(toxic)
                        changed.append(version is not low)
                        x.append(summed(*read.matches(version), scores)[: len(PRIOR)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(changed, pa.bool_()), pa.array(x, pa.list_(pa.float64()))], names=["key", "changed", "x"])

    rows = fit.select("toxic", "text").mapInArrow(features, "key int, changed boolean, x array<double>").collect()  # two short rows for each of FIT_DOCS
    given, changed = ([r for r in rows if r["changed"] == c] for c in (False, True))
    y = np.array([r["key"] for r in given], float)
    if 0 < y.sum() < len(y):
        weights = _logistic(np.array([r["x"] for r in given]), y, PRIOR, floored=FLOORED)
        if changed:
            start = np.where(np.arange(len(PRIOR)) == MISSPELLED, PRIOR, weights)
            weights = _logistic(np.array([r["x"] for r in changed]), np.array([r["key"] for r in changed], float), start, floored=FLOORED, free=(MISSPELLED,))
    else:
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        weights = np.array([log(share / (1 - share)), 0, 0, 0, 0])
    return words, beginnings, fuzzy, ordinary, scores, weights


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, score, predicted, and the counts of exact, misspelled and quoted matches."""
    with small_batches(docs.sparkSession):
        words, beginnings, fuzzy, ordinary, scores, weights = fitted(fit_sample(docs, labels, id_col, text_col, label_col))
    reader = lambda: Reader(words, beginnings, fuzzy, ordinary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(k, BATCH_ROWS)
                x = np.array([read.features(t.as_py(), scores) for t in part.column(2)]).reshape(-1, len(weights) + 3)
                p = 1 / (1 + np.exp(-np.clip(x[:, : len(weights)] @ weights, -30, 30)))
                counts = x[:, len(weights) :].astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(p), pa.array((p >= CUT).astype(np.int32)), *(pa.array(counts[:, i]) for i in range(3))], names=["doc_id", "held_out", "score", "predicted", "exact", "misspelled", "quoted"])

    ids = F.col(f"`{id_col}`").alias("doc_id")
    every = docs.select(ids, held_out(F.col(f"`{id_col}`")).alias("held_out"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return every.mapInArrow(run, f"doc_id {every.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, exact long, misspelled long, quoted long")
