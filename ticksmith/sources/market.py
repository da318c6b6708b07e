"""Sources of market data: stored ticks and logs, venue payloads as JSON, synthetic feeds."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticksmith import schemas
from ticksmith.functions.scalars import coerce_float, normalize_symbol

#: Intervals that the venue's bar history has, in seconds; fixed values.
HISTORY_INTERVALS = [60, 300, 900, 3600, 14400, 86400, 604800]


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A Parquet table with its declared schema; empty where nothing has been written yet."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ddl)


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.TICK)


def latest(rows: DataFrame, limit: int | None = 10) -> DataFrame:
    """Newest first by ingest id; without a limit all rows."""
    ordered = rows.orderBy(F.desc("id"))
    return ordered if limit is None else ordered.limit(limit)


def history_bars(payloads: DataFrame, symbol: str, seconds: int, exchange: str = "kraken") -> DataFrame:
    """Bars from history responses (a column ``json`` of arrays of rows); rows that aren't seven long are skipped."""
    if seconds not in HISTORY_INTERVALS:
        raise ValueError(f"interval must be one of {HISTORY_INTERVALS}")
    rows = payloads.select(F.explode(F.from_json("json", "array<array<string>>")).alias("r")).where(F.size("r") >= 7)
    at = lambda k: coerce_float(F.col("r")[k])
    return rows.select(F.lit(exchange).alias("exchange"), F.lit(symbol).alias("symbol"), F.lit(seconds).alias("interval_seconds"), F.timestamp_seconds(at(0)).alias("ts"), *(at(k).alias(n) for k, n in ((1, "open"), (2, "high"), (3, "low"), (4, "close"), (6, "volume"))))


def firi_ticks(payloads: DataFrame, symbol: str) -> DataFrame:
    """Ticks from ``json`` market lists: the last price stands for bid and ask."""
    row = F.explode(F.from_json("json", "array<struct<id: string, last: string, todays_volume: string>>"))
    found = payloads.select("ts", row.alias("m")).where(F.col("m.id") == normalize_symbol(F.lit(symbol)))
    last = coerce_float(F.col("m.last"))
    return found.select(F.lit("firi").alias("exchange"), F.lit(symbol).alias("symbol"), "ts", last.alias("bid"), last.alias("ask"), last.alias("last"), coerce_float(F.col("m.todays_volume")).alias("volume"))


def kraken_ticks(payloads: DataFrame, symbol: str) -> DataFrame:
    """Ticks from ``json`` tickers: a, b, c and v hold ask, bid, last and volume."""
    t = F.from_json("json", "a array<string>, b array<string>, c array<string>, v array<string>")
    at = lambda name, k: coerce_float(F.get(F.col(f"t.{name}"), k))
    return payloads.select("ts", t.alias("t")).select(F.lit("kraken").alias("exchange"), F.lit(symbol).alias("symbol"), "ts", at("b", 0).alias("bid"), at("a", 0).alias("ask"), at("c", 0).alias("last"), at("v", 1).alias("volume"))


def mock_walk(spark: SparkSession, symbols: list[str], ticks: int, start: float = 1_000_000.0, sigma: float = 0.0005, seed: int = 1) -> DataFrame:
    """A seeded random walk for each symbol, a tick a second; the product of steps is a sum of logarithms."""
    rows = spark.range(ticks).withColumn("symbol", F.explode(F.array(*map(F.lit, symbols))))
    step = F.log1p(sigma * F.randn(seed))
    last = F.lit(start) * F.exp(F.sum("step").over(Window.partitionBy("symbol").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)))
    walk = rows.withColumn("step", step).withColumn("last", last)
    half = F.greatest(F.lit(1.0), F.col("last") * 0.0002)
    return walk.select("id", F.lit("mock").alias("exchange"), "symbol", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("ts"), (F.col("last") - half).alias("bid"), (F.col("last") + half).alias("ask"), "last", (0.1 + 2.4 * F.rand(seed + 1)).alias("volume"))


def fx_rates(wanted: DataFrame, rates: DataFrame, live: DataFrame | None = None, fallback: float = 1.0) -> DataFrame:
    """(pair, rate, origin) of every wanted pair: the newest stored rate, else the mid of the live quote, else the fallback.

    ``rates``: id, pair, rate; ``live``: pair, bid, ask. Pairs that nobody has stored or quotes keep their row.
    """
    newest = rates.groupBy("pair").agg(F.max_by("rate", "id").alias("stored"))
    out = wanted.select("pair").distinct().join(newest, "pair", "left")
    if live is not None:
        mids = live.groupBy("pair").agg(F.max((F.col("bid") + F.col("ask")) / 2).alias("mid"))
        out = out.join(mids, "pair", "left")
    else:
        out = out.withColumn("mid", F.lit(None).cast("double"))
    origin = F.when(F.col("stored").isNotNull(), "stored").when(F.col("mid").isNotNull(), "live").otherwise("fallback")
    return out.select("pair", F.coalesce("stored", "mid", F.lit(fallback)).alias("rate"), origin.alias("origin"))


def demo_bars(spark: SparkSession, count: int = 60) -> DataFrame:
    """A made series for demonstrations, a bar a minute: the price steps by the bar's number, a running sum."""
    step = F.when(F.col("id") % 3 != 0, 0.6).otherwise(-0.2) + F.when(F.col("id") % 5 == 0, 0.15).otherwise(0.0)
    close = F.lit(100.0) + F.sum(step).over(Window.partitionBy("symbol").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    rows = spark.range(count).withColumn("symbol", F.lit("BTC/NOK")).withColumn("close", close)
    c = F.col("close")
    return rows.select(F.lit("demo").alias("exchange"), "symbol", F.lit(60).alias("interval_seconds"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60).alias("ts"), (c - 0.5).alias("open"), (c + 1.5).alias("high"), (c - 1.5).alias("low"), "close", (10.0 + F.col("id")).alias("volume"))


#: Mids of the made order books, fixed values.
DEMO_MIDS = [100.0, 101.0, 99.5, 100.8, 102.0, 101.0]


def demo_books(spark: SparkSession) -> DataFrame:
    """Six made books of three levels a side, a minute apart; spreads grow from 0.6 by 0.05."""
    half = (0.6 + F.col("id") * 0.05) / 2
    mid = F.element_at(F.array(*map(F.lit, DEMO_MIDS)), (F.col("id") + 1).cast("int"))

    def side(sign: float):
        return F.array(*(F.struct((mid + sign * (half + 0.2 * k)).alias("price"), F.lit(round(0.8 - 0.2 * k, 1)).alias("size")) for k in range(3)))

    return spark.range(len(DEMO_MIDS)).select("id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60).alias("ts"), side(-1.0).alias("bids"), side(1.0).alias("asks"))
