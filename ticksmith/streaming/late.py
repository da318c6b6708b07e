"""Streamed bars that keep what comes too late: late ticks go to a table of their own, and a pass puts them right.

Each micro-batch is cut by the watermark that earlier batches left: ticks of bars that are still open are merged into the
table of bars, ticks of finished bars are kept with the bar that they would have changed. Bars are stored as what composes
(first and last price with their times, extremes, volume), so corrections are one more merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticksmith.operators.bars import check_interval
from ticksmith.sources.market import read_table
from ticksmith.streaming import tables
from ticksmith.streaming.bars import write_once

KEYS = ["day", "exchange", "symbol", "bar"]
_EDGE = "struct<ts: timestamp, id: bigint, price: double>"
PARTS = f"day date, exchange string, symbol string, bar timestamp, first {_EDGE}, last {_EDGE}, high double, low double, volume double"
MERGE: tables.Merge = {"first": F.min, "last": F.max, "high": F.max, "low": F.min, "volume": F.sum}
LATE = "id long, exchange string, symbol string, ts timestamp, bid double, ask double, last double, volume double, bar timestamp"


def with_bar(ticks: DataFrame, seconds: int) -> DataFrame:
    """Add the start of each tick's bar."""
    return ticks.withColumn("bar", F.window("ts", f"{check_interval(seconds)} seconds")["start"])


def bar_parts(ticks: DataFrame) -> DataFrame:
    """Ticks with their bar as mergeable parts of bars; prices and ties as in ``stream_bars``."""
    price = F.coalesce("last", "bid")
    edge = F.struct("ts", (-F.col("id")).alias("id"), price.alias("price"))
    return ticks.groupBy(F.to_date("bar").alias("day"), "exchange", "symbol", "bar").agg(
        F.min(edge).alias("first"), F.max(edge).alias("last"), F.max(F.greatest(price, F.col("ask"))).alias("high"), F.min(F.least(price, F.col("bid"))).alias("low"), F.sum(F.coalesce("volume", F.lit(0.0))).alias("volume"),
    )


def bars_of(parts: DataFrame, seconds: int) -> DataFrame:
    return parts.select("exchange", "symbol", F.lit(seconds).alias("interval_seconds"), F.col("bar").alias("ts"), F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "volume")


def _newest(spark: SparkSession, path: str, before: int) -> int | None:
    """The newest time, in microseconds, that batches before this one had: an entry of one row."""
    return read_table(spark, f"{path}/newest/batch={before - 1}", "newest long").agg(F.max("newest")).first()[0]


def take_batch(ticks: DataFrame, batch_id: int, path: str, seconds: int, delay_seconds: int) -> None:
    """A micro-batch into bars and late ticks, for ``foreachBatch``; a repeated batch changes nothing.

    A bar is finished when the watermark, the newest time of earlier batches less the delay, has reached its end.
    """
    spark = ticks.sparkSession
    seen = _newest(spark, path, batch_id)
    rows = with_bar(ticks.select(*(c.split()[0] for c in LATE.split(", ")[:-1])), seconds)
    late = F.lit(False) if seen is None else F.unix_micros("bar") + seconds * 1_000_000 <= seen - delay_seconds * 1_000_000
    write_once(rows.where(late), batch_id, f"{path}/late")
    tables.apply_batch(bar_parts(rows.where(~late)), batch_id, f"{path}/bars", KEYS, MERGE)
    newest = F.greatest(F.max(F.unix_micros("ts")), F.lit(seen).cast("long"))
    ticks.agg(newest.alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{path}/newest/batch={batch_id}")


def late_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Ticks that came after their bar was finished, with that bar; those of batches in the ledger."""
    done = tables._committed(spark, f"{path}/bars")
    return read_table(spark, f"{path}/late", f"{LATE}, batch long").where(F.col("batch") <= done).drop("batch")


def streamed_bars(spark: SparkSession, path: str, seconds: int) -> DataFrame:
    """Bars as the stream has them, without what came late."""
    return bars_of(tables.current(spark, f"{path}/bars", "day", PARTS), seconds)


def corrected_bars(spark: SparkSession, path: str, seconds: int) -> DataFrame:
    """Bars with late ticks merged in: what a batch over all ticks gives."""
    known = tables.current(spark, f"{path}/bars", "day", PARTS)
    both = known.unionByName(bar_parts(late_ticks(spark, path)))
    return bars_of(both.groupBy(*KEYS).agg(*(f(c).alias(c) for c, f in MERGE.items())), seconds)


def corrections(spark: SparkSession, path: str, seconds: int) -> DataFrame:
    """The bars that late ticks change, as they should be."""
    touched = late_ticks(spark, path).select("exchange", "symbol", F.col("bar").alias("ts")).distinct()
    bars = corrected_bars(spark, path, seconds)
    return bars.join(touched, ["exchange", "symbol", "ts"], "left_semi").select(*bars.columns)
