"""Indicators and column strategies over one ordered series; all share a window, so Spark sorts once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ticksmith.functions import scalars as S


@dataclass(frozen=True)
class Series:
    """The keys of a series and the total order of its rows."""

    by: tuple[str, ...] = ("exchange", "symbol")
    order: tuple[str, ...] = ("ts",)

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def trailing(self, rows: int) -> WindowSpec:
        """The last ``rows`` rows with the current one."""
        return self.window.rowsBetween(1 - rows, 0)

    @property
    def so_far(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, 0)


def _sign(value: Column) -> Column:
    return F.when(value > 0, 1.0).when(value < 0, -1.0).otherwise(0.0)


# --- strategies: a signal in -1, 0, 1 for each bar


def moving_average_crossover(series: Series, short_window: int = 3, long_window: int = 6) -> Column:
    """Sign of the short mean less the long one, 0 until the long window is full. Means are compared at 10 places."""
    if not 0 < short_window <= long_window:
        raise ValueError("windows must be positive, the short one not longer than the long one")
    close = F.col("close")
    short = F.round(F.avg(close).over(series.trailing(short_window)), 10)
    long = F.round(F.avg(close).over(series.trailing(long_window)), 10)
    return F.when(F.row_number().over(series.window) < long_window, 0.0).otherwise(_sign(short - long))


def _move(series: Series, lookback: int, threshold: float) -> Column:
    before = F.lag("close", lookback).over(series.window)
    change = F.round(F.try_divide(F.col("close") - before, before), 10)
    return F.when((before > 0) & (change > threshold), 1.0).when((before > 0) & (change < -threshold), -1.0).otherwise(0.0)


def momentum_breakout(series: Series, lookback: int = 5, threshold: float = 0.01) -> Column:
    return _move(series, lookback, threshold)


def signal_trend(series: Series, lookback: int = 1, threshold: float = 0.001) -> Column:
    return _move(series, lookback, threshold)


def threshold_signal(series: Series, threshold: float = 0.02) -> Column:
    return _move(series, 1, threshold)


@dataclass
class StrategyRegistry:
    """Strategies by name: functions of a series and parameters to a signal column."""

    strategies: dict[str, Callable[..., Column]] = field(default_factory=lambda: {"moving_average_crossover": moving_average_crossover, "momentum_breakout": momentum_breakout, "signal_trend": signal_trend, "threshold": threshold_signal})

    def register(self, name: str, strategy: Callable[..., Column]) -> None:
        if not callable(strategy):
            raise TypeError("a strategy must be callable")
        self.strategies[name] = strategy

    def get(self, name: str) -> Callable[..., Column]:
        return self.strategies[name]

    def resolve(self, name: str, series: Series = Series(), **params) -> Column:
        """The signal column; parameters that a strategy doesn't know are an error."""
        return self.get(name)(series, **params)


# --- indicators


def true_range(series: Series) -> Column:
    before = F.lag("close").over(series.window)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_trend_filter(bars: DataFrame, series: Series = Series(), lookback: int = 14, multiplier: float = 2.0) -> DataFrame:
    """Add momentum, volatility (mean true range by ``multiplier``), value and direction; a first bar is neutral."""
    if lookback < 2:
        raise ValueError("lookback must be at least 2")
    rows = bars.withColumns({"tr": true_range(series), "momentum": F.coalesce(F.col("close") - F.lag("close").over(series.window), F.lit(0.0)), "first": F.row_number().over(series.window) == 1})
    rows = rows.withColumn("tr", F.when(F.col("first"), None).otherwise(F.col("tr")))
    volatility = F.coalesce(F.avg("tr").over(series.trailing(lookback - 1)) * multiplier, F.lit(0.0))
    rows = rows.withColumn("volatility", F.round(volatility, 10)).withColumn("momentum", F.round("momentum", 10))
    strong = F.abs("momentum") > F.col("volatility") * 0.5
    direction = F.when((F.col("momentum") > 0) & strong, "up").when((F.col("momentum") < 0) & strong, "down").otherwise("neutral")
    return rows.withColumns({"value": F.round(F.when(F.col("volatility") > 0, F.col("momentum") / F.col("volatility")).otherwise(0.0), 10), "direction": F.when(F.col("first"), "neutral").otherwise(direction)}).drop("tr", "first")


def with_returns(bars: DataFrame, series: Series = Series()) -> DataFrame:
    """Add ``ret``, the simple return; null on a first bar and after a close that isn't positive."""
    before = F.lag("close").over(series.window)
    return bars.withColumn("ret", F.when(before > 0, F.try_divide(F.col("close") - before, before)))


def rolling_volatility(series: Series = Series(), window: int = 10) -> Column:
    """Population deviation of the returns between the last ``window`` closes, 0 without any. Needs ``ret``."""
    return F.coalesce(F.stddev_pop("ret").over(series.trailing(window - 1)), F.lit(0.0)) if window > 1 else F.lit(0.0)


def kelly_multiplier(series: Series = Series(), window: int = 20, fraction: float = 0.5) -> Column:
    """Share of the Kelly bet by the returns between the last ``window`` closes. Needs ``ret``.

    The first bar of a series gives 1. Fewer than two returns give 1 after any gain and else 0; without losses half of
    the fraction, without gains a quarter.
    """
    w = series.trailing(window - 1)
    r = F.col("ret")
    n, wins, losses = (F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(w), F.lit(0)) for c in (r.isNotNull(), r > 0, r < 0))
    gain, loss = F.avg(F.when(r > 0, r)).over(w), F.avg(F.when(r < 0, -r)).over(w)
    ratio = F.try_divide(gain, loss)
    rate = F.try_divide(wins, n)
    bet = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(rate * ratio - (1.0 - rate), ratio)))
    return (
        F.when(F.row_number().over(series.window) == 1, 1.0)
        .when(n < 2, F.when(wins > 0, 1.0).otherwise(0.0))
        .when(losses == 0, F.when(wins > 0, fraction * 0.5).otherwise(fraction * 0.25))
        .when(wins == 0, fraction * 0.25)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), bet * fraction)))
    )


def stale_quote(series: Series = Series(), max_age_seconds: int = 900) -> Column:
    """Whether the bar comes later than the limit after the one before."""
    if max_age_seconds <= 0:
        return F.lit(False)
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(series.window))
    return F.coalesce(gap > max_age_seconds * 1_000_000, F.lit(False))


def running_peak(series: Series, value: str = "equity") -> Column:
    return F.max(value).over(series.so_far)


def with_risk_inputs(bars: DataFrame, series: Series = Series(), volatility_window: int = 10, kelly_window: int = 20, kelly_fraction: float = 0.5, max_age_seconds: int = 900) -> DataFrame:
    """Everything that the risk gate takes from bars, so that folds hold positions only."""
    rows = with_returns(bars, series)
    return rows.withColumns(
        {
            "volatility_pct": rolling_volatility(series, volatility_window),
            "kelly": kelly_multiplier(series, kelly_window, kelly_fraction),
            "slippage_pct": S.body_pct(F.col("open"), F.col("close")),
            "spread_pct": S.range_pct(F.col("high"), F.col("low"), F.col("close")),
            "stale": stale_quote(series, max_age_seconds),
        }
    )


def with_signals(bars: DataFrame, signals: DataFrame, by: list[str], at: str = "ts") -> DataFrame:
    """Add ``signals`` (by, at, signal) from outside to ``bars``; an error where a series has more or fewer signals than bars.

    Two signals of a series, or two bars, at one time are an error too. A bar without a signal of its own time has none.
    Both are one union grouped by key and time, so bars are made once and nothing is doubled.
    """
    kept = [c for c in bars.columns if c not in (*by, at, "signal")]
    a = bars.select(*by, at, F.struct(F.lit(1).alias("_"), *kept).alias("_bar"), F.lit(None).cast("double").alias("signal"), F.lit(0).alias("_given"))
    b = signals.select(*by, at, F.lit(None).cast(a.schema["_bar"].dataType).alias("_bar"), F.col("signal").cast("double"), F.lit(1).alias("_given"))
    rows = a.unionByName(b).groupBy(*by, at).agg(F.first("_bar", ignorenulls=True).alias("_bar"), F.first("signal", ignorenulls=True).alias("signal"), F.sum("_given").alias("_given"), F.count("_bar").alias("_bars"))
    of = Window.partitionBy(*by)
    n_bars, n_signals = F.sum("_bars").over(of), F.sum("_given").over(of)
    what = F.when(F.max(F.greatest("_given", "_bars")).over(of) > 1, "two signals or bars of one time:").when(n_bars != n_signals, "bars and signals must be the same length:")
    rows = rows.withColumns({"_what": what, "_n": F.concat_ws(" ", n_bars.cast("string"), n_signals.cast("string"))})
    wrong = F.raise_error(F.concat_ws(" ", "_what", F.concat_ws("|", *by), "_n")).cast("boolean")
    checked = rows.where(F.when(F.col("_what").isNull(), True).otherwise(wrong)).where("_bar IS NOT NULL")
    order = bars.columns if "signal" in bars.columns else [*bars.columns, "signal"]
    return checked.select(*by, at, *(F.col(f"_bar.{c}").alias(c) for c in kept), "signal").select(*order)


def with_strategy(bars: DataFrame, strategy: Callable[[list[dict], int, dict], object], by: list[str], order: list[str] = ["ts"]) -> DataFrame:
    """Add the signal of any Python strategy ``(history, index, bar)``; ``history`` are the bars up to this one, as dicts.

    The slow path, for rules that no column expresses: one series is one Python call, bar by bar. What it returns, a
    number, a word or nothing, is a signal by ``normalize_signal``.
    """
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        history: list[dict] = []
        signals = []
        for bar in frame.to_dict("records"):
            history.append(bar)
            value = strategy(history, len(history) - 1, bar)
            signals.append(None if value is None else str(value))
        return frame.assign(signal=signals)

    plain = bars.drop("signal")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.groupBy(*by).applyInPandas(run, f"{ddl}, signal string").withColumn("signal", S.normalize_signal(F.col("signal")))


def for_symbol(bars: DataFrame, symbol: str) -> DataFrame:
    """The bars of one symbol, whether or not its name has a separator."""
    return bars.where(S.normalize_symbol(F.col("symbol")) == S.normalize_symbol(F.lit(symbol)))
