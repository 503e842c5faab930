r"""Chats formatted as windows of a token budget, and read back.

A turn is written `<|im_start|>role`, a line end, its text, `<|im_end|>` and a line end. Control strings of this and of other templates
are escaped inside texts and roles: a backslash goes in after the first sign, before any that stand there already, so that the
way back is exact. Roles hold no line end: it is written \n, and a backslash as two.

Prefix sums of the turns' tokens choose spans that end with turns. Each window after the first repeats the system turn and as many of
the last turns as `history` tokens hold, then goes on with new turns up to `budget` tokens. Texts of the assistant are
under the loss mask where they are new, and masked where they are repeated: each is learnt from once.

A turn isn't cut: one that is longer than the budget has a window without history, which is then longer. The system turn is a conversation's
first turn, if its role is `system`; one with more than half the budget isn't repeated.

Planning sees numbers only, in segments of a conversation (a window doesn't reach over two), and a hot conversation has many
segments. Texts meet window by window. Reading back, a conversation's turns are hashed as a stream.

Cases: a null role or text is empty. Turns with equal numbers (or null ones, which come first) go by the SHA-256 of role and text; repeated
rows are turns of their own. Rows without a conv_id belong to no conversation and are left out. No rows give no windows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import hot_join, small_batches, written
from gridloom.llm.order import in_order, numbered, sequential_sha256
from gridloom.llm.tokens import encoder

#: The marks of a turn, and control strings of common chat templates.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROLS = [OPEN, CLOSE, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
BUDGET, HISTORY = 1024, 256
#: Turns of a conversation that are planned together, and turns before them that they may repeat.
SEGMENT, LOOK_BACK = 1024, 64
REST = "(" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")"
PLAN = "conv_id long, segment long, window int, idx long, uid long, again boolean, system boolean"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + REST, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + REST, "$1$2$3")


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    parts = F.split(unescaped(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def _counted(path: str | None):
    """Adds `tokens`: how many ids the piece has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = batch.column(batch.schema.get_field_index("piece")).to_pylist()
            tokens = [len(ids) // 4 for ids in encoder(path).encode(pieces)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int32())], names=[*batch.schema.names, "tokens"])

    return run


def pieces_of(turns: DataFrame, path: str | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every turn as it is written, with its number of tokens: conv_id, turn, tie, uid, role, piece, head and body (characters), tokens."""
    by, said = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    rows = turns.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.sha2(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said).cast("binary"), 256).alias("tie"),
        by.alias("role"),
        F.concat(F.lit(OPEN), _role_out(by), F.lit("\n")).alias("before"),
        escaped(said).alias("body"),
    )
    rows = rows.withColumn("uid", F.monotonically_increasing_id()).select(
        "conv_id", "turn", "tie", "uid", "role", F.concat("before", "body", F.lit(f"{CLOSE}\n")).alias("piece"), F.char_length("before").alias("head"), F.char_length("body").alias("body")
    )
    schema = ", ".join(f"{c} {k}" for c, k in rows.dtypes) + ", tokens int"
    return rows.mapInArrow(_counted(path), schema)


def spans(tokens: np.ndarray, old: int, system: int, first_is_system: bool, budget: int, history: int) -> Iterator[tuple[int, int, int, bool]]:
    """Windows over turns of so many `tokens`, of which the first `old` have been new before: (repeated from, new from, new to, with system turn)."""
    upto = np.concatenate([[0], np.cumsum(tokens)])  # tokens before each turn
    start, count = old, len(tokens)
    kept = min(history, budget - system)
    least = 1 if first_is_system else 0  # the system turn is no history
    while start < count:
        lone = first_is_system and start == 0  # the system turn itself is new here
        room = budget - (0 if lone else system)
        back = min(kept, room - int(tokens[start]))
        begin = min(start, max(least, int(np.searchsorted(upto, upto[start] - back)))) if back > 0 else start
        end = max(start + 1, int(np.searchsorted(upto, upto[begin] + room, "right")) - 1)
        yield begin, start, end, bool(system) and not lone
        start = end


def _planned(budget: int, history: int):
    """Windows of each (conv_id, segment), whose rows come in order."""
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[k]) for n, k in (x.split() for x in PLAN.split(", "))])

    def plan(key: tuple[int, int], rows: list[tuple]) -> Iterator[tuple]:
        idx, uid, tokens, old, system, system_uid = zip(*rows, strict=True)
        cuts = spans(np.array(tokens), sum(old), system[0], idx[0] == 0 and system[0] > 0, budget, history)
        for window, (begin, start, end, with_system) in enumerate(cuts):
            if with_system:
                yield (*key, window, 0, system_uid[0], True, True)
            for i in range(begin, end):
                yield (*key, window, idx[i], uid[i], i < start, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, out = None, [], []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        for batch in batches:
            for conv, segment, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current != (conv, segment):
                    if held:
                        out.extend(plan(current, held))
                    current, held = (conv, segment), []
                held.append(row)
            if len(out) > 10_000:
                yield made()
                out = []
        if held:
            out.extend(plan(current, held))
        if out:
            yield made()

    return run


def planned(pieces: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Which turns are in which windows: conv_id, segment, window, idx, uid, again (repeated), system."""
    narrow = pieces.select("conv_id", "turn", "tie", "uid", "tokens", (F.col("role") == "system").alias("is_system"))
    placed = written(numbered(in_order(narrow, "chat-order", "conv_id", F.col("turn").asc_nulls_first(), "tie", "uid"), "conv_id"), "chat-placed")
    keeps = F.col("is_system") & (F.col("tokens") * 2 <= budget)
    heads = placed.filter("idx = 0").select("conv_id", F.when(keeps, F.col("tokens")).otherwise(0).alias("system"), F.col("uid").alias("system_uid"), "n")
    rows = hot_join(placed.drop("n", "turn", "tie", "is_system"), heads, "conv_id", "n", placed.count())
    rows = rows.withColumn("segment", F.floor(F.col("idx") / SEGMENT)).withColumn("old", F.lit(0))
    after = (F.col("segment") + 1) * SEGMENT
    earlier = rows.filter((F.col("idx") + LOOK_BACK >= after) & (after < F.col("n"))).withColumn("segment", F.col("segment") + 1).withColumn("old", F.lit(1))
    dealt = rows.unionByName(earlier).select("conv_id", "segment", "idx", "uid", "tokens", "old", "system", "system_uid")
    return dealt.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "idx").mapInArrow(_planned(budget, history), PLAN)


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, path: str | None = None, **columns: str) -> DataFrame:
    """A row for each window: conv_id, segment and window (its order), text, loss (spans of characters: start, length), repeats (turns at its beginning
    that are repeated), n_tokens."""
    pieces = written(pieces_of(turns, path, **columns), "chat-pieces")
    plan = written(planned(pieces, budget, history), "chat-plan")
    texts = pieces.select("uid", "piece", "head", "body", "tokens", (F.col("role") == "assistant").alias("target"))
    near = plan.filter("NOT system").join(texts, "uid")
    # one system turn may be in most windows; it has half the budget's tokens at most
    of_system = plan.filter("system")
    systems = written(of_system.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).join(texts, "uid"), "chat-systems")
    rows = near.unionByName(hot_join(of_system, systems, "uid", "n", of_system.count()).drop("n"))
    part = F.struct("idx", "again", "piece", "head", "body", "tokens", "target")
    groups = rows.groupBy("conv_id", "segment", "window").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))

    def further(acc: Column, p: Column) -> Column:
        span = F.array(F.struct((acc["at"] + p["head"]).alias("start"), p["body"].alias("length")))
        return F.struct((acc["at"] + F.char_length(p["piece"])).alias("at"), F.when(p["target"] & ~p["again"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return groups.select(
        "conv_id",
        "segment",
        "window",
        F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("text"),
        F.aggregate("parts", begun, further)["spans"].alias("loss"),
        F.size(F.filter("parts", lambda p: p["again"])).alias("repeats"),
        F.aggregate("parts", F.lit(0), lambda n, p: n + p["tokens"]).alias("n_tokens"),
    )


def write_windows(turns: DataFrame, path: str, **how) -> None:
    """Write `windows` as files under `path`."""
    rows = windows(turns, **how)
    with small_batches(turns.sparkSession):
        rows.write.parquet(path)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """A row for each window, read from its text alone: its new turns (role, text), and what its loss mask covers, unescaped."""
    found = F.regexp_extract_all("text", F.lit("(?s)" + re.escape(OPEN) + "(.*?)" + re.escape(CLOSE) + "\n"), F.lit(1))
    new = F.slice(found, F.col("repeats") + 1, F.size(found))

    def turn(t: Column) -> Column:
        role = F.substring_index(t, "\n", 1)
        return F.struct(_role_in(role).alias("role"), unescaped(F.substring(t, F.char_length(role) + 2, F.char_length(t))).alias("text"))

    covered = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return spark.read.parquet(path).select("conv_id", "segment", "window", F.char_length("text").alias("chars"), F.transform(new, turn).alias("turns"), covered.alias("covered"))


def digests(read: DataFrame) -> DataFrame:
    """For each conversation, from what was read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    line = F.lit("\n")
    rows = read.select(
        "conv_id",
        "segment",
        "window",
        "chars",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line)), "").cast("binary").alias("turns_sha256"),
        F.array_join("covered", "").alias("loss"),
    ).withColumn("loss_sha256", F.col("loss").cast("binary"))
    hashed = sequential_sha256(rows, "conv_id", ["segment", "window"], ["turns_sha256", "loss_sha256"])
    sums = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum(F.char_length("loss").cast("long")).alias("loss_chars"), F.sum(F.col("chars").cast("long")).alias("formatted_chars"))
    return hashed.join(sums, "conv_id").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
