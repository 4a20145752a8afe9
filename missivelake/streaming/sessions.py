"""Live conversations by a stateful operator with event-time timers.

For every contact the state holds its open conversations, a row each: ends, counts, and who wrote first and last. Rows of a
batch are sorted and cut at gaps among themselves, and what is left, at most a row for each gap, is joined with the open ones;
so messages may come in any order within the delay, and one that falls between two conversations makes them one. A timer at
the last moment at which a message could still belong to a conversation puts it out and takes it from the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from missivelake.config import DEFAULT, Config
from missivelake.operators.messages import ME

STATE = "start_ms long, start_row long, started_by int, end_ms long, end_row long, final_reply_by int, my_count long, total_count long"
OUT = "contact_id string, start_ms long, end_ms long, started_by int, final_reply_by int, my_count long, their_count long, total_count long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Open = tuple[int, int, int, int, int, int, int, int]  # a row of STATE


def cut(ts: np.ndarray, row: np.ndarray, sender: np.ndarray, timeout: int) -> list[Open]:
    """Conversations of some messages by themselves."""
    order = np.lexsort((row, ts))
    ts, row, sender = ts[order], row[order], sender[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(ts) > timeout]))
    last = np.concatenate([first[1:], [len(ts)]]) - 1
    mine = np.add.reduceat((sender == ME).astype(np.int64), first)
    columns = (ts[first], row[first], sender[first], ts[last], row[last], sender[last], mine, last - first + 1)
    return list(zip(*(c.tolist() for c in columns), strict=True))


def joined(parts: list[Open], timeout: int) -> list[Open]:
    """Conversations with those made one that are no further apart than the timeout, in order."""
    out: list[Open] = []
    for p in sorted(parts):
        if out and p[0] - out[-1][3] <= timeout:
            a = out[-1]
            end = max(a[3:6], p[3:6])
            out[-1] = (*a[:3], *end, a[6] + p[6], a[7] + p[7])
        else:
            out.append(p)
    return out


class Conversations(StatefulProcessor):
    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", STATE)

    def _held(self) -> list[Open]:
        return [tuple(r) for r in self.open.get()] if self.open.exists() else []

    def _hold(self, rows: list[Open]) -> None:
        if rows:
            self.open.put(rows)
        else:
            self.open.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._held()
        parts = list(before)
        for df in rows:
            if len(df):
                parts = joined(parts + cut(df.timestamp_ms.to_numpy(), df.rowid.to_numpy(), df.sender.to_numpy(), self.timeout), self.timeout)
        due = {p[3] + self.timeout + 1 for p in parts}
        for t in {p[3] + self.timeout + 1 for p in before} - due:
            self.handle.deleteTimer(t)
        for t in due:
            self.handle.registerTimer(t)
        self._hold(parts)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = self._held()
        over = [p for p in held if p[3] + self.timeout + 1 <= now]
        self._hold([p for p in held if p[3] + self.timeout + 1 > now])
        if over:
            yield pd.DataFrame(
                [(key[0], p[0], p[3], p[2], p[5], p[6], p[7] - p[6], p[7]) for p in over],
                columns=[x.split()[0] for x in OUT.split(", ")],
            )

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def live_conversations(messages: DataFrame, delay: str = "1 hour", cfg: Config = DEFAULT) -> DataFrame:
    """Conversations of a stream of contact messages, each once the watermark has passed its end and the timeout: the columns
    of the batch job that need no later conversation. Messages later than the delay are dropped here and repaired by a
    refresh of their contacts."""
    with_state_store(messages.sparkSession)
    rows = messages.withColumn("ts", F.timestamp_millis("timestamp_ms")).withWatermark("ts", delay)
    rows = rows.select("contact_id", "ts", "timestamp_ms", F.col("rowid").cast("long").alias("rowid"), F.col("sender").cast("int").alias("sender"))
    return rows.groupBy("contact_id").transformWithStateInPandas(Conversations(cfg.conversation_timeout_ms), OUT, "Append", "EventTime")
