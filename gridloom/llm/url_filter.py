"""URL filter: host and path rules, and character language models for the urls that no rule fits.

Urls that a rule accepts or rejects are the labelled rows; each distinct one counts once. From half of them (by hash) one
model of accepted and one of rejected urls is counted: character n-grams of orders 0 to `ORDER`, interpolated after Witten
and Bell, so that a context that was never seen falls back on its shorter suffixes (`CharModel` is the definition). A
url's score is the difference of its log-likelihoods under both, over its length. The threshold is calibrated on the other
half, which the models haven't seen. A url above it is allowed.

Both halves are counted whole, as tables of grams that grow with the input and are neither collected nor broadcast by
hand. Rows are dealt in blocks of `BLOCK`; a block asks once for each of its grams, so that no gram is a hot key, and gets
their scores back. Only the histogram of the held-out scores comes to the driver.

The models learn and score whole urls, query string and fragment included; the rules look at host and path alone.

Cases: a null url, or one without ://, has an empty host and path, and no rule fits it. A null url is scored as an empty
string, which is allowed (nothing speaks against it); one without :// is scored as it is. Without two distinct labelled
urls of both kinds everything that no rule fits is allowed. Repeated rows are judged alike. Columns beside id and url are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ascii_lower, written

#: The rules of the registered query: verdict, and host and path together.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
ORDER = 4
#: Rows that ask for the scores of their grams together, and bins of the held-out scores' histogram in a unit of score.
BLOCK = 4096
BINS = 4096
#: Marks for the start and the end of a url.
START, END = "\x02", "\x03"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path columns of a url."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: struct(rule, verdict), or null. A rule fits its host and all subdomains."""
    out = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class CharModel:
    """Counts of characters after contexts of up to ORDER characters, smoothed after Witten and Bell."""

    order: int = ORDER
    total: dict[str, int] = field(default_factory=dict)
    kinds: dict[str, int] = field(default_factory=dict)
    seen: dict[str, int] = field(default_factory=dict)

    def learn(self, text: str) -> None:
        text = START * self.order + text + END
        for i in range(self.order, len(text)):
            for k in range(self.order + 1):
                context, gram = text[i - k : i], text[i - k : i + 1]
                self.total[context] = self.total.get(context, 0) + 1
                n = self.seen.get(gram, 0)
                if not n:
                    self.kinds[context] = self.kinds.get(context, 0) + 1
                self.seen[gram] = n + 1

    def chance(self, gram: str) -> float:
        """Probability of the last character after those before it."""
        p = 1 / 65536
        for k in range(len(gram)):
            context = gram[len(gram) - 1 - k : -1]
            if (total := self.total.get(context, 0)) == 0:
                break
            kinds = self.kinds[context]
            p = (self.seen.get(gram[len(gram) - 1 - k :], 0) + kinds * p) / (total + kinds)
        return p


def grams(text: str, order: int = ORDER) -> list[str]:
    """For each character of a text and its end: that character after the `order` before it."""
    padded = START * order + text + END
    return [padded[i : i + order + 1] for i in range(len(text) + 1)]


def counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, a, b): how often a gram of full order is in the accepted and in the rejected of labelled urls (text, verdict)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = {"allow": Counter(), "block": Counter()}
            for text, verdict in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[verdict].update(grams(text, order))
            met = [*{*n["allow"], *n["block"]}]
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.string()), *(pa.array([n[v][g] for g in met], pa.int64()) for v in n)], names=["gram", "a", "b"])

    return labelled.mapInArrow(run, "gram string, a long, b long").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def log_ratios(counted: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, x): for each asked gram (distinct), the log of its last character's chance when accepted, less that when rejected.

    As CharModel.chance has it, from counts of grams of full order. Shorter grams are the ends of those.
    """
    end, context = F.expr("substring(gram, 2)"), F.expr("substring(gram, 1, length(gram) - 1)")
    levels = [(counted, asked)]
    for _ in range(order):
        seen, need = levels[-1]
        levels.append((seen.groupBy(end.alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")), need.select(end.alias("gram")).distinct()))
    chances = None
    for seen, need in reversed(levels):
        sums = [f(v).alias(f"{name}_{v}") for v in "ab" for name, f in (("total", F.sum), ("kinds", lambda v: F.count_if(F.col(v) > 0)))]
        rows = need.join(seen, "gram", "left").withColumn("context", context).join(seen.groupBy(context.alias("context")).agg(*sums), "context", "left")
        if chances is None:
            rows = rows.withColumn("p_a", F.lit(1 / 65536)).withColumn("p_b", F.lit(1 / 65536))
        else:
            rows = rows.withColumn("end", end).join(chances.withColumnRenamed("gram", "end"), "end")
        chance = lambda v: F.expr(f"CASE WHEN total_{v} > 0 THEN (coalesce({v}, 0) + kinds_{v} * p_{v}) / (total_{v} + kinds_{v}) ELSE p_{v} END")
        chances = rows.select("gram", chance("a").alias("p_a"), chance("b").alias("p_b"))
    return chances.select("gram", (F.log("p_a") - F.log("p_b")).alias("x"))


def threshold(bins: list[tuple[float, float, int, int]]) -> float:
    """The cut with the fewest errors on either side, as shares; in the middle of the gap where there is one.

    Bins are (least score, greatest score, allowed, blocked), in order; cuts are between them.
    """
    allowed, blocked = sum(x[2] for x in bins), sum(x[3] for x in bins)
    wrong = [allowed * blocked]
    for _, _, a, b in bins:
        wrong.append(wrong[-1] + a * blocked - b * allowed)
    best = wrong.index(min(wrong))
    if best == 0:
        return bins[0][0] - 1.0
    return (bins[best - 1][1] + bins[best][0]) / 2 if best < len(bins) else bins[-1][1] + 1.0


def scores(rows: DataFrame, labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """`rows` (block, text and others) with their score, from models of `labelled` (text, verdict)."""

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met: dict[int, set[str]] = {}
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                met.setdefault(block, set()).update(grams(text, order))
            for block, found in met.items():
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array([*found], pa.string())], names=["block", "gram"])

    def summed(own: pa.Table, answers: pa.Table) -> pa.Table:
        x = dict(zip(answers.column("gram").to_pylist(), answers.column("x").to_pylist(), strict=True))
        sums = [sum(map(x.__getitem__, grams(t, order))) / (len(t) + 1) for t in own.column("text").to_pylist()]
        return own.append_column("score", pa.array(sums, pa.float64()))

    asked = written(rows.select("block", "text").mapInArrow(asks, "block long, gram string"), "asked")
    known = log_ratios(written(counts(labelled, order), "grams"), asked.select("gram").distinct(), order)
    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.groupBy("block").cogroup(asked.join(known, "gram").groupBy("block")).applyInArrow(summed, f"{fields}, score double")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (log-likelihood difference a character; null without models)."""
    host, path = parsed(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"), F.col(f"`{url_col}`").alias("url")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", "fit.rule", F.col("fit.verdict").alias("said"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("text"))
    rows = written(rows.select("*", F.expr(f"monotonically_increasing_id() div {BLOCK}").alias("block"), F.xxhash64("text").alias("hash")), "urls")
    ends = {r["said"]: r for r in rows.filter("said is not null").groupBy("said").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).collect()}
    if len(ends) == 2 and all(r["low"] < r["high"] for r in ends.values()):
        # each kind has a url in either half
        low, high = ([r[k] for r in ends.values()] for k in ("low", "high"))
        held = F.col("hash").isin(high) | (F.expr("hash % 2 <> 0") & ~F.col("hash").isin(low))
        labelled = rows.filter("said is not null").select("text", F.col("said").alias("verdict"), held.alias("held")).distinct()
        rows = written(scores(rows, labelled.filter("NOT held").select("text", "verdict")), "scored")
        unseen = rows.filter("said is not null").filter(held).select("text", "said", "score").dropDuplicates(["text"])
        kinds = [F.count_if(F.col("said") == v) for v in ("allow", "block")]
        cut = threshold(sorted(r[1:] for r in unseen.groupBy(F.floor(F.col("score") * BINS)).agg(F.min("score"), F.max("score"), *kinds).collect()))
    else:
        rows, cut = rows.withColumn("score", F.lit(None).cast("double")), 0.0
    fine = (F.col("text") == "") | F.col("score").isNull() | (F.col("score") >= cut)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(fine, "allow").otherwise("block")).alias("verdict"), "score")
