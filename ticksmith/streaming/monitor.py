"""What streaming queries have done over their whole runs, from the engine's own progress events."""

from __future__ import annotations

import threading
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class Health:
    """Counts of one query, over restarts from its checkpoint."""

    name: str | None = None
    starts: int = 0
    batches: int = 0
    rows: int = 0
    late_rows: int = 0
    errors: int = 0
    last_batch: int = -1
    last_seen: float | None = None
    running: bool = False
    error: str | None = None


class Monitor(StreamingQueryListener):
    """Add up each query's progress as it is reported; queries go by the id that their checkpoint keeps.

    A query's own ``recentProgress`` forgets all but its newest reports; here nothing is forgotten, and a query holds one
    row of counts however long it runs.
    """

    def __init__(self) -> None:
        self._health: dict[str, Health] = {}
        self._lock = threading.Lock()

    def _of(self, query_id) -> Health:
        return self._health.setdefault(str(query_id), Health())

    def onQueryStarted(self, event) -> None:
        with self._lock:
            h = self._of(event.id)
            h.name, h.running, h.starts = event.name, True, h.starts + 1
            h.last_seen = pd.Timestamp(event.timestamp).timestamp()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            h = self._of(p.id)
            if p.batchId > h.last_batch or p.numInputRows:
                h.batches += p.batchId > h.last_batch
                h.last_batch = max(h.last_batch, p.batchId)
                h.rows += p.numInputRows
            h.late_rows += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            h.last_seen = pd.Timestamp(p.timestamp).timestamp()

    def onQueryIdle(self, event) -> None:
        with self._lock:
            self._of(event.id).last_seen = pd.Timestamp(event.timestamp).timestamp()

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            h = self._of(event.id)
            h.running, h.error = False, event.exception
            h.errors += event.exception is not None

    def health(self, query_id) -> Health:
        """A copy of a query's counts."""
        with self._lock:
            return Health(**vars(self._of(query_id)))

    def stalled(self, timeout_seconds: float, now: float) -> list[str]:
        """Ids of running queries that were last heard of too long ago."""
        with self._lock:
            return sorted(i for i, h in self._health.items() if h.running and h.last_seen is not None and now - h.last_seen > timeout_seconds)


def watch(spark: SparkSession) -> Monitor:
    """A monitor of the session's queries, from now on."""
    monitor = Monitor()
    spark.streams.addListener(monitor)
    return monitor
