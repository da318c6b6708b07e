"""Market feeds as Spark data sources: ``spark.read.format("tick_feed")`` and ``spark.readStream.format("tick_feed")``.

A connector gives a venue's next ticks of some symbols from where it stood. The one here walks at random from a seed; one
that polls a venue needs ``start`` and ``fetch`` only. A stream's offset holds all that a connector needs to go on or to
give the same ticks again, so a restart from a checkpoint repeats no tick and loses none.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

TICK_FIELDS = "id long, exchange string, symbol string, ts timestamp, bid double, ask double, last double, volume double"
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


class WalkConnector:
    """A random walk a symbol, a tick a second: steps of ``sigma``, half spreads of 0.02 % but 1 at least."""

    def __init__(self, symbols: list[str], seed: int = 1, start: float = 1_000_000.0, sigma: float = 0.0005):
        self.symbols, self.seed, self.first, self.sigma = symbols, seed, start, sigma

    def start(self) -> dict:
        return {"n": 0, "last": {s: self.first for s in self.symbols}}

    def walk(self, offset: dict, ticks: int) -> Iterator[tuple]:
        """The next ``ticks`` of each symbol, one after another; ``offset`` moves along. The same offset gives the same ticks."""
        last = offset["last"]
        for n in range(offset["n"], offset["n"] + ticks):
            for k, s in enumerate(self.symbols):
                rng = random.Random(f"{self.seed}/{s}/{n}")
                price = last[s] = last[s] * math.exp(math.log1p(self.sigma * rng.gauss(0.0, 1.0)))
                half = max(1.0, price * 0.0002)
                yield (n * len(self.symbols) + k, "mock", s, EPOCH + timedelta(seconds=n), price - half, price + half, price, rng.uniform(0.1, 2.5))
            offset["n"] = n + 1

    def fetch(self, offset: dict, ticks: int) -> tuple[list[tuple], dict]:
        """The ticks of ``walk`` and the offset behind them, as a poll gives them; ``offset`` stays as it is."""
        end = {"n": offset["n"], "last": dict(offset["last"])}
        return list(self.walk(end, ticks)), end


class _Batch(DataSourceReader):
    """Each symbol is a partition of its own."""

    def __init__(self, connect, symbols: list[str], ticks: int):
        self.connect, self.symbols, self.ticks = connect, symbols, ticks

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.symbols]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        connector = self.connect([partition.value])
        place, n = self.symbols.index(partition.value), len(self.symbols)
        for i, *rest in connector.walk(connector.start(), self.ticks):
            yield (i * n + place, *rest)


class _Stream(SimpleDataSourceStreamReader):
    """``ticks`` of each symbol a micro-batch, up to ``total``: what a poll brings is small and read on the driver."""

    def __init__(self, connector: WalkConnector, ticks: int, total: int | None):
        self.connector, self.ticks, self.total = connector, ticks, total

    def initialOffset(self) -> dict:
        return self.connector.start()

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        ticks = self.ticks if self.total is None else min(self.ticks, self.total - start["n"])
        rows, end = self.connector.fetch(start, ticks)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.connector.fetch(start, end["n"] - start["n"])[0])

    def commit(self, end: dict) -> None:
        """Ticks follow from the offset; there is nothing to release."""


class TickFeed(DataSource):
    """Options: ``symbols`` (comma-separated), ``ticks`` (a batch read, or a micro-batch), ``total``, ``seed``."""

    @classmethod
    def name(cls) -> str:
        return "tick_feed"

    def schema(self) -> str:
        return TICK_FIELDS

    def _symbols(self) -> list[str]:
        found = [s.strip() for s in self.options.get("symbols", "BTC/NOK").split(",") if s.strip()]
        if not found or int(self.options.get("ticks", 60)) < 1:
            raise ValueError("a feed needs a symbol, and at least one tick")
        return found

    def _connect(self, symbols: list[str]) -> WalkConnector:
        return WalkConnector(symbols, int(self.options.get("seed", 1)))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._connect, self._symbols(), int(self.options.get("ticks", 60)))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        total = self.options.get("total")
        return _Stream(self._connect(self._symbols()), int(self.options.get("ticks", 60)), int(total) if total else None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TickFeed)
