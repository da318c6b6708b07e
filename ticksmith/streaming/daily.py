"""The daily summary kept from streams of trades, equity snapshots and events; equal to the batch report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticksmith.streaming import tables

_SNAPSHOT = "struct<ts: timestamp, id: bigint, equity: double>"
DAYS = f"report_date date, total_trades bigint, ending {_SNAPSHOT}, peak double, trough double, alert_count bigint"
MERGE: tables.Merge = {"total_trades": F.sum, "ending": F.max, "peak": F.max, "trough": F.min, "alert_count": F.sum}


def log_rows(trades: DataFrame, equity: DataFrame, events: DataFrame) -> DataFrame:
    """Three logs as one stream of rows (kind, ts, id, equity), so that one query keeps the summary."""
    kind = lambda rows, name, value: rows.select(F.lit(name).alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"), value.cast("double").alias("equity"))
    alerts = events.where("event_type = 'runtime_alert'")
    return kind(trades, "trade", F.lit(None)).unionByName(kind(equity, "equity", F.col("equity"))).unionByName(kind(alerts, "alert", F.lit(None)))


def take_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Merge a micro-batch of ``log_rows`` into the days that it touches, once; for ``foreachBatch``."""
    of = lambda k, value: F.when(F.col("kind") == k, value)
    equity = F.col("equity")
    days = rows.groupBy(F.to_date("ts").alias("report_date")).agg(
        F.count(of("trade", 1)).alias("total_trades"), F.max(of("equity", F.struct("ts", "id", "equity"))).alias("ending"), F.max(of("equity", equity)).alias("peak"), F.min(of("equity", equity)).alias("trough"), F.count(of("alert", 1)).alias("alert_count"),
    )
    tables.apply_batch(days, batch_id, path, ["report_date"], MERGE)


def summary(spark: SparkSession, path: str, default_equity: float = 1000.0) -> DataFrame:
    """The report of the table as it stands, with the columns of ``reports.daily_summary``; a row a day is read."""
    days = tables.current(spark, path, "report_date", DAYS)
    before = F.last("ending.equity", ignorenulls=True).over(Window.orderBy("report_date").rowsBetween(Window.unboundedPreceding, -1))
    has, base = F.col("ending").isNotNull(), F.lit(default_equity)
    start, end = F.when(has, F.coalesce(before, base)).otherwise(base), F.coalesce("ending.equity", base)
    down = F.coalesce(F.greatest(F.lit(0.0), F.col("peak") - F.col("trough")), F.lit(0.0))
    return days.select(
        "report_date", "total_trades", start.alias("starting_equity"), end.alias("ending_equity"), (end - start).alias("total_pnl"),
        down.alias("max_drawdown"), F.when(F.col("peak") > 0, down / F.col("peak")).otherwise(0.0).alias("max_drawdown_pct"), "alert_count",
    )
