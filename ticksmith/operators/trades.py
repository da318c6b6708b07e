"""FIFO pairing of buys and sells by scan algebra and one equi-join; no queue is kept anywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticksmith.operators.scans import SPLIT_ROWS, with_running


def _numbered(fills: DataFrame, by: list[str], order: list[str], split_rows: int) -> DataFrame:
    """Buys and the sells that find one open, numbered by side; ``order`` begins with a time.

    With s the running sum of +1 for buys and -1 for sells and m its least value with 0, the queue before a row holds
    ``s' - m'`` of the row before it: a sell is valid if that is positive. Each sell that isn't lowers m by one, so ``-m``
    of all sells were invalid. One scan gives all of that, in chunks where a key is hot.
    """
    buy = F.when(F.col("side") == "buy", 1).otherwise(0)
    step = 2 * buy - 1
    rows = with_running(fills.where(F.col("side").isin("buy", "sell")), by, order, {"_buys": ("sum", buy), "_sells": ("sum", 1 - buy), "_low": ("low_before", step)}, split_rows)
    s = F.col("_buys") - F.col("_sells")
    low = F.least(F.lit(0), "_low")
    rows = rows.where((F.col("side") == "buy") | (s + 1 - low > 0))
    return rows.withColumn("k", F.when(F.col("side") == "buy", F.col("_buys")).otherwise(F.col("_sells") + low)).drop("_buys", "_sells", "_low")


def _same(by: list[str]) -> Column:
    """Equal keys, of which the right side's begin with an underscore; null keys are equal."""
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.lit(True))


def round_trips(fills: DataFrame, by: list[str], order: list[str], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """The k-th valid sell closes the k-th buy, at the sell's size."""
    rows = _numbered(fills, by, order, split_rows)
    buys = rows.where("side = 'buy'").select(*(F.col(c).alias(f"_{c}") for c in [*by, "k"]), F.col("ts").alias("entry_time"), F.col("price").alias("entry_price"), F.col("fee").alias("entry_fee"))
    sells = rows.where("side = 'sell'").select(*by, "k", F.col("ts").alias("exit_time"), F.col("price").alias("exit_price"), "size", F.col("fee").alias("exit_fee"))
    out = sells.join(buys, (F.col("k") == F.col("_k")) & _same(by)).drop(*(f"_{c}" for c in [*by, "k"]))
    gross = (F.col("exit_price") - F.col("entry_price")) * F.col("size")
    fees = F.col("entry_fee") + F.col("exit_fee")
    return out.withColumns({"total_fees": fees, "gross_pnl": gross, "net_pnl": gross - fees})


def open_positions(fills: DataFrame, by: list[str], order: list[str], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Buys that no sell has closed: those numbered above their key's valid sells, which are counted, not matched."""
    rows = _numbered(fills, by, order, split_rows)
    closed = rows.where("side = 'sell'").groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.count("*").alias("_closed"))
    buys = rows.where("side = 'buy'").join(closed, _same(by), "left")
    return buys.where(F.col("k") > F.coalesce("_closed", F.lit(0))).select(*by, "ts", "price", "size", "fee", "k")


def latest_open(positions: DataFrame, n: int = 5, order: list[str] = ["ts", "k"]) -> DataFrame:
    """The newest n open buys, a report's top-k."""
    return positions.orderBy(*map(F.desc, order)).limit(n)


def round_trip_stats(trips: DataFrame, by: list[str]) -> DataFrame:
    net = F.col("net_pnl")
    n = F.count("*")
    return trips.groupBy(*by).agg(
        n.alias("round_trips"), F.count(F.when(net > 0, 1)).alias("wins"), F.count(F.when(net <= 0, 1)).alias("losses"), (F.count(F.when(net > 0, 1)) / n).alias("win_rate"),
        F.sum("gross_pnl").alias("gross_pnl"), F.sum("total_fees").alias("total_fees"), F.sum("net_pnl").alias("net_pnl"), F.avg("net_pnl").alias("avg_pnl"),
    )


def latest_trips(trips: DataFrame, n: int = 5, order: list[str] = ["exit_time", "k"]) -> DataFrame:
    """The last n closed trades, a report's top-k."""
    return trips.orderBy(*map(F.desc, order)).limit(n)
