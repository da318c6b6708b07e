"""Streaming bars, alerts and supervision: the batch operators' expressions under Structured Streaming."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ticksmith.operators.bars import check_interval


def stream_bars(ticks: DataFrame, seconds: int, watermark: str = "10 minutes") -> DataFrame:
    """Bars by event time. Late ticks within the watermark go to their bar; a bar is final once the watermark passes.

    In update mode open bars are shown too, which is what a flush at the end of input gives.
    """
    last = F.coalesce("last", "bid")
    rows = ticks.withWatermark("ts", watermark).withColumns({"o": last, "h": F.greatest(last, F.col("ask")), "l": F.least(last, F.col("bid")), "v": F.coalesce("volume", F.lit(0.0))})
    order = F.struct("ts", -F.col("id"))
    bars = rows.groupBy("exchange", "symbol", F.window("ts", f"{check_interval(seconds)} seconds").alias("w")).agg(F.min_by("o", order).alias("open"), F.max("h").alias("high"), F.min("l").alias("low"), F.max_by("o", order).alias("close"), F.sum("v").alias("volume"))
    return bars.select("exchange", "symbol", F.lit(seconds).alias("interval_seconds"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def write_once(rows: DataFrame, batch_id: int, path: str) -> None:
    """A ``foreachBatch`` sink that a repeated batch can't double: each batch owns a folder and overwrites it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def alert_edges(states: DataFrame) -> DataFrame:
    """Edges of alerts from (key, id, active): raised once until cleared, over all micro-batches.

    State is one boolean a key; rows of a key are put in order within a micro-batch.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active = state.get[0] if state.exists else False
        rows = pd.concat(list(frames)).sort_values("id", kind="stable")
        ids, edges = [], []
        for i, now in zip(rows["id"].tolist(), rows["active"].tolist(), strict=True):
            if bool(now) != active:
                active = bool(now)
                ids.append(i)
                edges.append("raised" if active else "cleared")
        state.update((active,))
        yield pd.DataFrame({"key": [key[0]] * len(ids), "id": ids, "edge": edges}).astype({"id": "int64"})

    return states.groupBy("key").applyInPandasWithState(step, "key string, id long, edge string", "active boolean", "append", GroupStateTimeout.NoTimeout)


@dataclass
class Backoff:
    """Waiting times between retries: initial * factor^(n-1), at most ``cap``, and a jitter."""

    initial: float = 1.0
    factor: float = 2.0
    cap: float = 60.0
    jitter: float = 0.1
    attempts: int = 0

    def next(self, uniform: Callable[[float, float], float] = random.uniform) -> float:
        self.attempts += 1
        wait = min(self.cap, self.initial * self.factor ** (self.attempts - 1))
        return wait + uniform(0.0, self.jitter * wait)

    def reset(self) -> None:
        self.attempts = 0


def run_with_restarts(start: Callable[[], StreamingQuery], max_restarts: int = 3, backoff: Backoff | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Await a query and start it again from its checkpoint when it fails; returns the restarts that were needed."""
    backoff = backoff or Backoff()
    for n in range(max_restarts + 1):
        try:
            start().awaitTermination()
            return n
        except Exception:
            if n == max_restarts:
                raise
            sleep(backoff.next())
    raise AssertionError("unreachable")


def is_stalled(query: StreamingQuery, timeout_seconds: float, now: float) -> bool:
    """Whether the last finished micro-batch began too long ago."""
    progress = query.lastProgress
    return bool(progress) and now - pd.Timestamp(progress["timestamp"]).timestamp() > timeout_seconds


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were dropped, over the progress that the query still has."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def every(run: Callable[[], None], interval_seconds: float, cycles: int, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> int:
    """Call ``run`` ``cycles`` times, beginning every ``interval_seconds``; a cycle that takes longer is followed at once."""
    for n in range(cycles):
        began = clock()
        run()
        if n + 1 < cycles:
            sleep(max(0.0, interval_seconds - (clock() - began)))
    return cycles
