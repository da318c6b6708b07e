"""Recorded venue responses as a source, in batch and on a stream, pruned by venue, pair and day.

A response is a file ``venue=<name>/pair=<BTCNOK>/day=<2024-01-31>/<milliseconds>.json``, whole and as it came. The folders
are partition columns of Spark's file source: filters on them leave files unopened, on any file system, and a stream's
checkpoint keeps which files it has read. ``market.firi_ticks`` and ``kraken_ticks`` parse one venue's bare payloads.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticksmith.functions.scalars import coerce_float

RECORDED = "value string, venue string, pair string, day date"
#: Shapes of the venues' responses; fixed values.
FIRI = "array<struct<id: string, last: string, todays_volume: string>>"
KRAKEN = "struct<error: array<string>, result: map<string, struct<a: array<string>, b: array<string>, c: array<string>, v: array<string>>>>"


def read_payloads(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """(venue, pair, day, ts, json): responses with the time that their file's name gives."""
    reader = (spark.readStream if stream else spark.read).schema(RECORDED).option("wholetext", "true")
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    name = F.regexp_extract("_metadata.file_name", r"^(\d+)\.json$", 1)
    return reader.format("text").load(path).select("venue", "pair", "day", F.timestamp_millis(F.nullif(name, F.lit("")).cast("long")).alias("ts"), F.col("value").alias("json"))


def between(payloads: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Responses from ``start`` until before ``end``, both UTC; other days' folders aren't read."""
    day = lambda t: t.astimezone(timezone.utc).date()
    at = F.col("ts")
    return payloads.where(F.col("day").between(F.lit(day(start)), F.lit(day(end)))).where((at >= F.lit(start)) & (at < F.lit(end)))


def _quote() -> Column:
    """(bid, ask, last, volume, reason) of a response; null quotes where there is a reason."""
    market = F.get(F.filter(F.from_json("json", FIRI), lambda m: F.replace(F.upper(m["id"]), F.lit("/")) == F.col("pair")), 0)
    answer = F.from_json("json", KRAKEN)
    ticker = F.try_element_at(answer["result"], F.col("pair"))
    of = lambda bid, ask, last, volume: [coerce_float(c).alias(n) for c, n in ((bid, "bid"), (ask, "ask"), (last, "last"), (volume, "volume"))]
    at = lambda field, k: F.get(ticker[field], k)
    nothing = [F.lit(None).cast("double").alias(n) for n in ("bid", "ask", "last", "volume")]
    firi = F.struct(*of(market["last"], market["last"], market["last"], market["todays_volume"]), F.when(market.isNull(), "unsupported symbol").alias("reason"))
    error = F.when(F.size(answer["error"]) > 0, F.array_join(answer["error"], ", ")).when(ticker.isNull(), "unsupported symbol")
    kraken = F.struct(*of(at("b", 0), at("a", 0), at("c", 0), at("v", 1)), error.alias("reason"))
    return F.when(F.col("venue") == "firi", firi).when(F.col("venue") == "kraken", kraken).otherwise(F.struct(*nothing, F.lit("unknown venue").alias("reason")))


def payload_ticks(payloads: DataFrame) -> DataFrame:
    """(exchange, symbol, ts, bid, ask, last, volume) of the responses that quote their pair."""
    rows = payloads.withColumn("q", _quote()).where("q.reason IS NULL")
    return rows.select(F.col("venue").alias("exchange"), F.col("pair").alias("symbol"), "ts", "q.bid", "q.ask", "q.last", "q.volume")


def rejected_payloads(payloads: DataFrame) -> DataFrame:
    """(venue, pair, ts, reason, json) of the others: an error that the venue reports, or a pair that it doesn't quote."""
    return payloads.withColumn("q", _quote()).where("q.reason IS NOT NULL").select("venue", "pair", "ts", "q.reason", "json")
