"""Ticks to OHLCV bars: one aggregation, combined on the map side; it sorts, as opens and closes go by (time, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticksmith.functions import scalars as S

INTERVALS = [1, 60, 300, 1800, 3600, 86400]
KEYS = ["exchange", "symbol", "interval_seconds", "ts"]


def check_interval(seconds: int) -> int:
    if seconds not in INTERVALS:
        raise ValueError(f"interval must be one of {INTERVALS}")
    return seconds


def _quotes(ticks: DataFrame, intervals: list[int], null_only: bool) -> DataFrame:
    """Each tick's contribution to a bar. Two rules exist for missing quotes: zero counts as missing, or only null does."""
    last, bid, ask = F.col("last"), F.col("bid"), F.col("ask")
    if null_only:
        price = F.coalesce(last, bid)
        o = c = price
        h, low, v = F.greatest(price, ask), F.least(price, bid), F.coalesce("volume", F.lit(0.0))
    else:
        o = c = S.first_nonzero(last, bid)
        h, low, v = S.first_nonzero(last, ask), S.first_nonzero(bid, last), F.coalesce("volume", F.lit(0.0))
    width = F.lit(intervals[0]) if len(intervals) == 1 else F.explode(F.array(*map(F.lit, intervals)))
    rows = ticks.select("exchange", "symbol", "id", F.col("ts").alias("at"), o.alias("o"), h.alias("h"), low.alias("l"), c.alias("c"), v.alias("v"), width.alias("interval_seconds"))
    return rows.withColumn("ts", S.bucket_start(F.col("at"), F.col("interval_seconds")))


def _aggregate(rows: DataFrame) -> DataFrame:
    """Equal times: the highest id opens and the lowest closes, as ticks are read newest first and sorted stably."""
    order = F.struct("at", -F.col("id"))
    bars = rows.groupBy(*KEYS).agg(F.min_by("o", order).alias("open"), F.max("h").alias("high"), F.min("l").alias("low"), F.max_by("c", order).alias("close"), F.sum("v").alias("volume"))
    return bars.withColumn("interval_seconds", F.col("interval_seconds").cast("int"))


def build_bars(ticks: DataFrame, seconds: int, limit: int | None = None) -> DataFrame:
    """Bars of one interval; ``limit`` keeps the newest ticks by id first, as a report over recent ticks would."""
    if limit is not None:
        ticks = ticks.orderBy(F.desc("id")).limit(limit)
    return _aggregate(_quotes(ticks, [check_interval(seconds)], null_only=False))


def build_all_intervals(ticks: DataFrame, intervals: list[int] = INTERVALS) -> DataFrame:
    """Bars of all intervals by cascading: each interval's bars are made of the next finer one's.

    Every interval divides the next, so open, high, low and close are exact and the ticks are shuffled once; coarser
    levels shuffle bars only.
    """
    order = sorted(map(check_interval, intervals))
    first = _quotes(ticks, order[:1], null_only=False)
    at = F.struct("at", -F.col("id"))
    level = first.groupBy(*KEYS).agg(
        F.min_by(F.struct("o", "at", "id"), at).alias("first"), F.max("h").alias("high"), F.min("l").alias("low"), F.max_by(F.struct("c", "at", "id"), at).alias("final"), F.sum("v").alias("volume")
    )
    levels = [level]
    for seconds in order[1:]:
        up = level.withColumns({"interval_seconds": F.lit(seconds), "ts": S.bucket_start(F.col("ts"), seconds)})
        begin = F.struct(F.col("first.at"), -F.col("first.id"))
        end = F.struct(F.col("final.at"), -F.col("final.id"))
        level = up.groupBy(*KEYS).agg(F.min_by("first", begin).alias("first"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("final", end).alias("final"), F.sum("volume").alias("volume"))
        levels.append(level)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("exchange", "symbol", F.col("interval_seconds").cast("int").alias("interval_seconds"), "ts", F.col("first.o").alias("open"), "high", "low", F.col("final.c").alias("close"), "volume")


def build_stream_bars(ticks: DataFrame, seconds: int) -> DataFrame:
    """Bars by the streaming rule: only null is missing, highs see asks and lows see bids. Same for batch and stream."""
    return _aggregate(_quotes(ticks, [check_interval(seconds)], null_only=True))


def normalize_bars(bars: DataFrame, source: str = "normalizer") -> DataFrame:
    """Floor times to the bar's bucket, normalise symbols and note where the bars come from."""
    return bars.withColumns({"ts": S.bucket_start(F.col("ts"), F.col("interval_seconds")), "symbol": S.normalize_symbol(F.col("symbol")), "raw": F.create_map(F.lit("source"), F.lit(source))})
