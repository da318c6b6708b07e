"""The engine's views over the star-schema and event tables; each is a plain projection that Catalyst prunes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = ["BTC/NOK", "ETH/NOK", "SOL/NOK", "XRP/NOK"]
#: Levels a side in the synthetic books.
DEPTH = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pair_of(key: str):
    return F.element_at(F.array(*map(F.lit, PAIRS)), (F.col(key) % len(PAIRS) + 1).cast("int"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as quote ticks: the event type is the venue, four pairs by user."""
    pair = pair_of("user_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("exchange"),
        pair.alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 0.999, 6).alias("bid"),
        F.round(F.col("value") * 1.001, 6).alias("ask"),
        F.col("value").alias("last"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )


def price_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with prices pressed into 100 to 105.6, so that folds over returns stay bounded."""
    t = ticks(spark, sf_dir)
    px = F.round(100 + F.col("last") / 100, 6)
    return t.select("id", "exchange", "symbol", "ts", px.alias("bid"), px.alias("ask"), px.alias("last"), "volume")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as order books of eight levels a side, one a minute, dealt over the pairs."""

    def side(first: int, sign: int):
        return F.transform(F.slice("embedding", first, DEPTH), lambda x, i: F.struct(F.round(100 + sign * 0.05 * (i + 1), 4).alias("price"), F.round(F.abs(x.cast("double")) * 10, 4).alias("size")))

    e = table(spark, sf_dir, "embeddings")
    # mids move by label, so that signals change
    shift = F.col("label") % 5 * 0.01
    moved = lambda c: F.transform(c, lambda x: F.struct(F.round(x["price"] + shift, 4).alias("price"), x["size"].alias("size")))
    return e.select(F.col("vec_id").alias("id"), pair_of("vec_id").alias("symbol"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("vec_id") * 60).alias("ts"), moved(side(1, -1)).alias("bids"), moved(side(DEPTH + 1, 1)).alias("asks"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fills: status O buys, F sells. ``id`` orders them totally; equal rows are interchangeable."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("pair"),
        F.col("l_shipdate").alias("ts"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag").alias("id"),
        F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("fee"),
    )


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as equity snapshots, by source."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("source"), F.col("o_totalprice").alias("equity"))


def op_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an operational log: errors are blocked entries, their reason the key of their properties."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "ts",
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.when(F.col("event_type") == "error", "runtime_alert").when(k % 3 == 0, "order_lifecycle").otherwise("entry_decision").alias("event_type"),
        F.col("event_type").alias("source"),
        F.to_json(F.struct((k % 2 == 0).alias("allowed"), F.concat(F.lit("reason_"), k % 7).alias("reason"), F.when(k % 2 == 0, "FILLED").otherwise("CANCELED").alias("status"))).alias("metadata"),
    )
