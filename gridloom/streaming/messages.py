"""Messages to a map, held until the map is ready, as a stream and as a table.

Until a map says `ready`, messages to it wait; then they come out once, in order, and later ones at once. The stream
keeps one flag and a list of waiting messages for each map (`transformWithState`), so restarts go on where they stopped; it needs the RocksDB
state store (spark.sql.streaming.stateStore.providerClass). A map that isn't ready in time gives its messages up, as `expired`. A stream
with timers never runs out of batches: one that should stop when its input is read needs spark.sql.streaming.noDataMicroBatches.enabled false.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridloom.functions.text import bridge_message

OUT = "map_id string, seq long, body string, outcome string"
#: Fixed value: the type of the message that says that a map is ready, in any case.
READY = "ready"


def says_ready(body: Column) -> Column:
    return F.lower(bridge_message(body)["type"]).eqNullSafe(F.lit(READY))


def delivered(messages: DataFrame) -> DataFrame:
    """map_id, seq, body, released_at: messages (map_id, seq, body) with the place in the map's order at which each comes out.

    Those of maps that never say ready aren't in it. Readiness is a partial minimum, so a map with most messages isn't sorted.
    """
    rows = messages.withColumn("is_ready", says_ready(F.col("body")))
    ready = rows.filter("is_ready").groupBy("map_id").agg(F.min("seq").alias("ready_at"))
    return rows.filter("NOT is_ready").join(ready, "map_id").select("map_id", "seq", "body", F.greatest("seq", "ready_at").alias("released_at"))


class Held(StatefulProcessor):
    """Messages of one map."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ready = handle.getValueState("ready", "ready boolean")
        self.waiting = handle.getListState("waiting", "seq long, body string")

    def _rows(self, key: tuple, held: list[tuple], outcome: str) -> pd.DataFrame:
        text = lambda values: pd.Series(values, dtype=object)
        return pd.DataFrame({"map_id": text([key[0]] * len(held)), "seq": pd.Series([m[0] for m in held], dtype="int64"), "body": text([m[1] for m in held]), "outcome": text([outcome] * len(held))})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        messages = list(zip(new["seq"].tolist(), new["body"].tolist(), strict=True))
        is_ready = new["is_ready"].tolist()
        out: list[tuple] = []
        open_ = self.ready.exists()
        held: list[tuple] = []
        for message, ready in zip(messages, is_ready, strict=True):
            if ready:
                if not open_:
                    out += [tuple(m) for m in self.waiting.get()] + held
                    held, open_ = [], True
                    self.ready.update((True,))
                    self.waiting.clear()
                    for timer in list(self.handle.listTimers()):
                        self.handle.deleteTimer(timer)
            elif open_:
                out.append(message)
            else:
                held.append(message)
        if held:
            if not self.waiting.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
            self.waiting.appendList(held)
        yield self._rows(key, out, "delivered")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = [tuple(m) for m in self.waiting.get()]
        self.waiting.clear()
        yield self._rows(key, held, "expired")

    def close(self) -> None:
        pass


def held_until_ready(messages: DataFrame, wait_ms: int = 600_000) -> DataFrame:
    """map_id, seq, body, outcome: the stream `messages` (map_id, seq, body) as it comes out."""
    rows = messages.select(F.col("map_id").cast("string").alias("map_id"), F.col("seq").cast("long").alias("seq"), "body", says_ready(F.col("body")).alias("is_ready"))
    return rows.groupBy("map_id").transformWithStateInPandas(Held(wait_ms), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")
