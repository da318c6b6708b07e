"""Walk-forward evaluation: overlapping folds of a series, each run as its own backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticksmith.operators.folds import BacktestConfig, backtests


def assign_folds(bars: DataFrame, by: list[str], train: int, test: int, step: int) -> DataFrame:
    """A row for each bar and fold that holds it: fold starts are generated from the bar's index, not joined.

    A bar is in at most ceil((train + test) / step) folds. Folds that don't fill are left out.
    """
    if min(train, test, step) <= 0:
        raise ValueError("windows and step must be positive")
    size = train + test
    keys = Window.partitionBy(*by)
    rows = bars.withColumns({"bar_index": F.row_number().over(keys.orderBy("ts")) - 1, "n_bars": F.count("*").over(keys)})
    low = F.greatest(F.lit(0), F.ceil((F.col("bar_index") - size + 1) / step).cast("int"))
    high = F.least(F.floor(F.col("bar_index") / step), F.floor((F.col("n_bars") - size) / step)).cast("int")
    folds = F.when((high >= low) & (F.col("n_bars") >= size), F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("fold", F.explode(folds)).withColumns({"start_index": F.col("fold") * step, "place": F.col("bar_index") - F.col("fold") * step})


def walk_forward(bars: DataFrame, by: list[str], config: BacktestConfig, train: int = 40, test: int = 20, step: int = 20) -> DataFrame:
    """One row a fold: equity at the end of training and of the fold, and the trades of the test part.

    ``bars`` carry signals that were computed within folds (``signals_within``) or need no history.
    """
    run = backtests(bars, {"walk": config}, [*by, "start_index"])
    keys = ["series"]
    curve = run.where("kind = 'equity'").groupBy(*keys).agg(F.max_by("equity", "seq").alias("final_equity"), F.max(F.when(F.col("seq") == train - 1, F.col("equity"))).alias("initial_equity"), F.max(F.when(F.col("seq") == train, F.col("ts"))).alias("test_ts"))
    trades = run.where("kind = 'trade'").join(curve.select("series", "test_ts"), "series").where("ts >= test_ts")
    t = trades.groupBy(*keys).agg(F.count("*").alias("trades"), F.count_if(F.col("return_pct") > 0).alias("wins"))
    out = curve.join(t, keys, "left")
    start = F.split("series", r"\|")
    ret = F.when(F.col("initial_equity") > 0, F.col("final_equity") / F.col("initial_equity") - 1.0).otherwise(0.0)
    trades_n = F.coalesce("trades", F.lit(0))
    return out.select(
        F.array_join(F.slice(start, 1, len(by)), "|").alias("series"), F.element_at(start, -1).cast("int").alias("start_index"), "initial_equity", "final_equity", ret.alias("return_pct"),
        trades_n.alias("trades"), F.when(trades_n > 0, F.col("wins") / trades_n).otherwise(0.0).alias("win_rate"),
    )


def summary(folds: DataFrame, by: list[str] = ["series"]) -> DataFrame:
    """Count, mean and exact median return, positive folds, and the mean's compound over the folds."""
    r = F.col("return_pct")
    n = F.count("*")
    return folds.groupBy(*by).agg(n.alias("fold_count"), F.round(F.avg(r), 6).alias("avg_return"), F.round(F.median(r), 6).alias("median_return"), F.count_if(r > 0).alias("positive_folds"), F.round(F.pow(1.0 + F.avg(r), n) - 1.0, 6).alias("cumulative_return"))
