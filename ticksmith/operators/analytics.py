"""Performance numbers of equity curves and trades, by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticksmith.operators.scans import SPLIT_ROWS, asof, with_oldest, with_running, with_trailing


def zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def range_drawdown(equity: Column) -> Column:
    """(peak - trough) / peak whatever their order; 0 if the peak isn't positive."""
    top = F.max(equity)
    return F.when(top > 0, (top - F.min(equity)) / top).otherwise(0.0)


def with_running_drawdown(curve: DataFrame, by: list[str], order: list[str], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Add peak, drawdown from it, and the lowest so far; ``order`` begins with a time."""
    rows = with_running(curve, by, order, {"peak": ("max", F.col("equity")), "trough": ("min", F.col("equity"))}, split_rows)
    peak = F.col("peak")
    return rows.withColumn("drawdown", F.when(peak > 0, (peak - F.col("equity")) / peak).otherwise(0.0))


def with_periodic_returns(curve: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    before = F.lag("equity").over(Window.partitionBy(*by).orderBy(*order))
    return curve.withColumn("ret", F.when(before > 0, F.col("equity") / before - 1.0))


def sharpe(ret: Column) -> Column:
    spread = F.stddev_pop(ret)
    return zero(F.when(spread > 0, F.avg(ret) / spread * F.sqrt(F.count(ret))))


def sortino(ret: Column) -> Column:
    """The deviation is of losses only, the mean and the count of all."""
    spread = F.stddev_pop(F.when(ret < 0, ret))
    return zero(F.when(spread > 0, F.avg(ret) / spread * F.sqrt(F.count(ret))))


def trade_metrics(ret: Column) -> dict[str, Column]:
    gain, loss = F.when(ret > 0, ret), F.when(ret < 0, -ret)
    n = F.count(ret)
    rate = zero(F.try_divide(F.count(gain).cast("double"), n))
    return {
        "trades": n,
        "win_rate": rate,
        "profit_factor": zero(F.try_divide(F.sum(gain), F.sum(loss))),
        "expectancy": F.when(n > 0, rate * zero(F.avg(gain)) - (1.0 - rate) * zero(F.avg(loss))).otherwise(0.0),
        "avg_trade_return": zero(F.avg(ret)),
        "avg_win": zero(F.avg(gain)),
        "avg_loss": zero(F.avg(loss)),
    }


def run_metrics(fold: DataFrame, initial_equity: float, keys: list[str] = ["series", "variant"]) -> DataFrame:
    """One row of metrics a run, from a fold's equity and trade rows."""
    curve = with_periodic_returns(fold.where("kind = 'equity'"), keys, ["seq"])
    e = curve.groupBy(*keys).agg(F.max_by("equity", "seq").alias("final_equity"), range_drawdown(F.col("equity")).alias("max_drawdown"), sharpe(F.col("ret")).alias("sharpe_ratio"), sortino(F.col("ret")).alias("sortino_ratio"))
    t = fold.where("kind = 'trade'").groupBy(*keys).agg(*(c.alias(n) for n, c in trade_metrics(F.col("return_pct")).items()))
    names = [n for n in t.columns if n not in keys]
    out = e.join(t, keys, "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})
    total = F.round(F.col("final_equity") / initial_equity - 1.0, 10)
    out = out.withColumns({"total_return": total, "calmar_ratio": F.when(F.col("max_drawdown") > 0, total / F.col("max_drawdown")).otherwise(0.0)})
    return out.withColumns({n: F.round(n, 10) for n, k in out.dtypes if k == "double"})


def equity_stats(curve: DataFrame, by: list[str]) -> DataFrame:
    """Start, end, peak, trough, range drawdown and gain of each curve; rows are ordered by (ts, id)."""
    order = F.struct("ts", "id")
    out = curve.groupBy(*by).agg(F.min_by("equity", order).alias("start_equity"), F.max_by("equity", order).alias("end_equity"), F.max("equity").alias("peak_equity"), F.min("equity").alias("trough_equity"), F.count("*").alias("snapshots"))
    down = F.col("peak_equity") - F.col("trough_equity")
    return out.withColumns({"max_drawdown": down, "max_drawdown_pct": F.when(F.col("peak_equity") > 0, down / F.col("peak_equity")).otherwise(0.0), "total_pnl": F.col("end_equity") - F.col("start_equity")})


def pnl_last_hour(curve: DataFrame, by: list[str], snapshots: int = 200, seconds: int = 3600) -> DataFrame:
    """Newest less oldest equity within the time before the newest snapshot, among the newest ``snapshots``."""
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("id"))
    newest = F.max("ts").over(Window.partitionBy(*by))
    order = F.struct("ts", "id")
    rows = curve.withColumns({"place": F.row_number().over(w), "age": F.unix_micros(newest.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))})
    return rows.where((F.col("place") <= snapshots) & (F.col("age") <= seconds * 1_000_000)).groupBy(*by).agg((F.max_by("equity", order) - F.min_by("equity", order)).alias("pnl_last_hour"), F.count("*").alias("snapshots"))


def trailing_pnl(curve: DataFrame, by: list[str], snapshots: int | None = None, seconds: int = 3600, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """The gain of the time before every snapshot: its equity less that of the oldest within ``seconds`` up to it.

    All snapshots within the time count. With ``snapshots`` only that many newest do, as in ``pnl_last_hour``; these are
    then a frame, and the time is looked up among them. The work of neither grows with the rows within that time. Rows of
    one time go by id, those without a time are compared among themselves; ``pnl`` and ``oldest``, the time of the row
    compared with, are added.
    """
    if snapshots is None:
        rows = with_oldest(curve, by, ["ts", "id"], seconds, {"_equity": "equity", "_ts": "ts"}, split_rows)
        return rows.select(*curve.columns, (F.col("equity") - F.col("_equity")).alias("pnl"), F.col("_ts").alias("oldest"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = with_trailing(curve, by, ["ts", "id"], snapshots, {"_rows": F.collect_list(F.struct(at.alias("at"), "ts", "equity"))}, split_rows)
    oldest = F.get(F.filter("_rows", lambda r: F.coalesce(r["at"] >= at - seconds * 1_000_000, at.isNull())), 0)
    return rows.withColumn("_old", oldest).select(*curve.columns, (F.col("equity") - F.col("_old.equity")).alias("pnl"), F.col("_old.ts").alias("oldest"))


def window_pnl(curve: DataFrame, by: list[str], seconds: int = 3600, slide_seconds: int = 900) -> DataFrame:
    """Newest less oldest equity of overlapping windows of event time, for batch and stream alike.

    A snapshot lies in ``seconds / slide_seconds`` windows. On a stream set a watermark on ``ts`` first.
    """
    if not 0 < slide_seconds <= seconds:
        raise ValueError("a window slides by more than nothing and at most its length")
    order = F.struct("ts", "id")
    w = F.window("ts", f"{seconds} seconds", f"{slide_seconds} seconds")
    out = curve.groupBy(*by, w.alias("w")).agg((F.max_by("equity", order) - F.min_by("equity", order)).alias("pnl"), F.max("equity").alias("peak"), F.min("equity").alias("trough"), F.count("*").alias("snapshots"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "pnl", "peak", "trough", "snapshots")


def update_metrics(curve: DataFrame, by: list[str], initial_equity: Column | float) -> DataFrame:
    """Current gain, drawdown from the peak, and distance to the worst equity, after the newest snapshot."""
    order = F.struct("ts", "id")
    out = curve.groupBy(*by).agg(F.max_by("equity", order).alias("equity"), F.max("equity").alias("peak"), F.min("equity").alias("worst"), F.min_by("equity", order).alias("first"))
    base = F.col("first") if initial_equity is None else F.lit(initial_equity)
    return out.select(*by, (F.col("equity") - base).alias("current_pnl"), F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(0.0).alias("current_drawdown"), (F.col("equity") - F.col("worst")).alias("above_worst"))


def mark_to_market(snapshots: DataFrame, ticks: DataFrame) -> DataFrame:
    """Snapshots (symbol, cash, position_size, avg_entry_price) marked at each symbol's newest quote.

    The quotes are one row a symbol after an aggregation that combines on the map side; Spark picks the join by size.
    """
    newest = ticks.groupBy("symbol").agg(F.max_by(F.coalesce("last", "bid"), F.struct("ts", "id")).alias("mark"))
    paper = F.col("position_size") * (F.col("mark") - F.coalesce("avg_entry_price", "mark"))
    return snapshots.join(newest, "symbol", "left").withColumns({"equity": F.col("cash") + F.col("position_size") * F.coalesce("mark", F.lit(0.0)), "unrealized_pnl": paper})


def marks_at(snapshots: DataFrame, ticks: DataFrame, tolerance_seconds: float | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Each snapshot (symbol, ts, cash, position_size, avg_entry_price) marked at the newest quote at or before its time.

    Quotes older than ``tolerance_seconds`` don't count. ``mark_to_market`` marks all snapshots at one newest quote.
    """
    quotes = ticks.select("symbol", "ts", "id", F.coalesce("last", "bid").alias("mark"))
    rows = asof(snapshots, quotes, ["symbol"], values=["mark"], order=["id"], tolerance_seconds=tolerance_seconds, split_rows=split_rows)
    mark = F.col("mark")
    return rows.withColumnRenamed("right_ts", "quoted").withColumns({"equity": F.col("cash") + F.col("position_size") * F.coalesce(mark, F.lit(0.0)), "unrealized_pnl": F.col("position_size") * (mark - F.coalesce("avg_entry_price", mark))})


def starting_equity(curve: DataFrame, by: list[str], default: float = 1000.0, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(by, day, first, previous, starting): the equity that each curve had strictly before its first snapshot of a day."""
    days = curve.groupBy(*by, F.to_date("ts").alias("day")).agg(F.min("ts").alias("first"))
    rows = asof(days, curve.select(*by, F.col("ts").alias("first"), "id", "equity"), by, "first", ["equity"], ["id"], strictly=True, split_rows=split_rows)
    return rows.select(*by, "day", "first", F.col("right_first").alias("previous"), F.coalesce("equity", F.lit(default)).alias("starting"))
