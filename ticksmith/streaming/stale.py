"""Stale feeds on a stream: an alert when nothing arrives, cleared by the next tick; keyed state with timers.

``reports.stale_edges`` is the same rule in batch. A feed's ticks wait in its state until the watermark has passed them,
so that ticks out of order within the watermark's delay give the batch's edges, however micro-batches cut them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EDGES = "exchange string, symbol string, at timestamp, edge string"


class StaleFeeds(StatefulProcessor):
    """State of a feed: its last tick that the watermark has passed, whether it is stale, and ticks that wait.

    One timer a feed: when the next waiting tick is due, when the feed turns stale, or when a stale feed is forgotten, with
    all of its state. Times are microseconds; timers are milliseconds, and later rather than early.
    """

    def __init__(self, limit: int, forget: int):
        self.limit, self.forget = limit, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.feed = handle.getValueState("feed", "last long, stale boolean")
        self.waiting = handle.getListState("waiting", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = {int(t) for frame in rows for t in frame["micros"]} - set(self._waiting())
        self.waiting.appendList([(t,) for t in sorted(times)])
        self._wake(min(self._waiting()))
        yield self._edges(key, [])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        last, stale = self.feed.get() if self.feed.exists() else (None, False)
        times, edges = sorted(self._waiting()), []
        due = [t for t in times if t <= now]
        for t in due:
            if last is not None and t - last > self.limit:
                if not stale:
                    edges.append((last + self.limit, "raised"))
                if t - last <= self.limit + self.forget:
                    edges.append((t, "cleared"))
            last, stale = t, False
        rest = times[len(due) :]
        if last is not None and not stale and now - last > self.limit:
            edges.append((last + self.limit, "raised"))
            stale = True
        forgotten = stale and now - last > self.limit + self.forget
        if rest:
            self.waiting.put([(t,) for t in rest])
        else:
            self.waiting.clear()
        if forgotten:
            self.feed.clear()
        elif last is not None:
            self.feed.update((last, stale))
        turns = [] if forgotten or last is None else [last + self.limit + (self.forget if stale else 0) + 1]
        if wake := [*rest[:1], *turns]:
            self._wake(min(wake), expiredTimerInfo.getExpiryTimeInMs())
        yield self._edges(key, edges)

    def _waiting(self) -> list[int]:
        return [row[0] for row in self.waiting.get()] if self.waiting.exists() else []

    def _wake(self, micros: int, fired: int | None = None) -> None:
        """Let the feed's only timer fire once the watermark reaches ``micros``, unless an earlier one is set.

        ``fired``: a timer that is being handled, which is still listed.
        """
        at, known = -(-micros // 1000), [t for t in self.handle.listTimers() if t != fired]
        if not known or at < min(known):
            for t in known:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    @staticmethod
    def _edges(key: tuple, edges: list[tuple[int, str]]) -> pd.DataFrame:
        words = lambda values: pd.Series(list(values), dtype=object)
        at = pd.Series(pd.to_datetime([t for t, _ in edges], unit="us"))
        return pd.DataFrame({"exchange": words(key[0] for _ in edges), "symbol": words(key[1] for _ in edges), "at": at, "edge": words(e for _, e in edges)})


def stale_edges(ticks: DataFrame, limit_seconds: float, forget_seconds: float = 86400.0, delay: str = "1 minute") -> DataFrame:
    """(exchange, symbol, at, edge) from a stream of ticks (exchange, symbol, ts).

    A feed is stale when its newest tick is more than ``limit_seconds`` older than the watermark, which follows the newest
    tick of all feeds by ``delay``. A feed stale for more than ``forget_seconds`` is forgotten: its next tick clears nothing.
    Needs the RocksDB state store.
    """
    rows = ticks.select("exchange", "symbol", "ts", F.unix_micros("ts").alias("micros")).withWatermark("ts", delay)
    processor = StaleFeeds(int(limit_seconds * 1e6), int(forget_seconds * 1e6))
    return rows.groupBy("exchange", "symbol").transformWithStateInPandas(processor, EDGES, "append", "EventTime")
