"""All queries of the market engine, with the DuckDB SQL that states the same result.

A query returns its operator's whole result. Doubles are rounded alike on both sides, times are zone-less.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticksmith.functions import costs, orderbook
from ticksmith.functions import scalars as S
from ticksmith.operators import analytics, bars, folds, indicators, reconcile, reports, risk, trades, walkforward
from ticksmith.operators.indicators import Series
from ticksmith.plans import sql as Q
from ticksmith.sources import market, views
from ticksmith.sources.views import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

PAIR = ["exchange", "symbol"]
BAR_KEYS = [*PAIR, "ts"]


def query(oracle: str | None = None, places: int = 6):
    """Register a query by its function's name; its doubles are rounded and its times made zone-less."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            # + 0.0 makes a negative zero a plain one
            fixed = {"double": lambda c: F.round(c, places) + F.lit(0.0), "timestamp": lambda c: F.col(c).cast("timestamp_ntz")}
            return out.select(*(fixed[k](n).alias(n) if k in fixed else n for n, k in out.dtypes))

        _QUERIES[f.__name__] = run
        if oracle:
            _SQL[f.__name__] = oracle
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.build_bars(views.ticks(spark, sf_dir), 3600)


def _px_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.build_bars(views.price_ticks(spark, sf_dir), 3600)


def _rounded(*names: str, places: int = 6, rest: str = "") -> str:
    return ", ".join([f"round({n}, {places}) AS {n}" for n in names] + ([rest] if rest else []))


_OHLC = "exchange, symbol, interval_seconds, ts, " + _rounded("open", "high", "low", "close", "volume")

# --- bars


@query(f"{Q.HOURLY} SELECT {_OHLC} FROM bars")
def ohlcv_1h(spark, sf_dir):
    return _bars(spark, sf_dir)


@query(f"WITH {Q.TICKS}, {Q.bars('bars', 'ticks', '86400')} SELECT {_OHLC} FROM bars")
def ohlcv_1d(spark, sf_dir):
    return bars.build_bars(views.ticks(spark, sf_dir), 86400)


@query(f"WITH {Q.TICKS}, {Q.bars('bars', 'ticks', widths='(SELECT unnest([1, 60, 300, 1800, 3600, 86400]) AS w)')} SELECT {_OHLC} FROM bars")
def ohlcv_multi_interval(spark, sf_dir):
    return bars.build_all_intervals(views.ticks(spark, sf_dir))


@query(f"WITH {Q.TICKS}, {Q.bars('bars', 'ticks', stream=True)} SELECT {_OHLC} FROM bars")
def ohlcv_stream_semantics(spark, sf_dir):
    return bars.build_stream_bars(views.ticks(spark, sf_dir), 3600)


@query(f"{Q.HOURLY} SELECT exchange, replace(upper(symbol), '/', '') AS symbol, interval_seconds, ts, {_rounded('open', 'high', 'low', 'close', 'volume')}, 'normalizer' AS source FROM bars")
def normalize_bars(spark, sf_dir):
    return bars.normalize_bars(_bars(spark, sf_dir)).withColumn("source", F.col("raw")["source"]).drop("raw")


@query(f"WITH {Q.TICKS} SELECT id, exchange, symbol, ts, {_rounded('bid', 'ask', 'last', 'volume')} FROM ticks ORDER BY id DESC LIMIT 100")
def latest_ticks(spark, sf_dir):
    """A report's newest hundred rows."""
    return views.ticks(spark, sf_dir).orderBy(F.desc("id")).limit(100)


@query(f"WITH {Q.TICKS} SELECT exchange, symbol, max(id) AS id, round(arg_max(last, id), 6) AS last FROM ticks GROUP BY ALL")
def latest_per_pair(spark, sf_dir):
    return views.ticks(spark, sf_dir).groupBy(*PAIR).agg(F.max("id").alias("id"), F.max_by("last", "id").alias("last"))


# --- indicators and strategies


def _signal(name: str, signal: str, oracle: str, **params) -> None:
    def run(spark, sf_dir):
        return _bars(spark, sf_dir).select(*BAR_KEYS, "close", indicators.StrategyRegistry().resolve(signal, **params).alias("signal"))

    run.__name__ = name
    query(f"{Q.HOURLY} SELECT exchange, symbol, ts, round(close, 6) AS close, {oracle} AS signal FROM bars")(run)


_signal("sma_crossover", "moving_average_crossover", Q.crossover())
_signal("momentum_breakout", "momentum_breakout", Q.move(5, 0.01))
_signal("signal_trend", "signal_trend", Q.move(1, 0.001))
_signal("threshold_signal", "threshold", Q.move(1, 0.02))

_ATR_SQL = f"""{Q.HOURLY}, t AS (
  SELECT *, lag(close) OVER ({Q.SERIES}) AS c0, row_number() OVER ({Q.SERIES}) = 1 AS first FROM bars),
u AS (SELECT *, CASE WHEN NOT first THEN greatest(high - low, abs(high - c0), abs(low - c0)) END AS tr, round(coalesce(close - c0, 0), 10) AS momentum FROM t),
v AS (SELECT *, round(coalesce(avg(tr) {Q.frame(13)} * 2.0, 0), 10) AS volatility FROM u)
SELECT exchange, symbol, ts, round(momentum, 6) AS momentum, round(volatility, 6) AS volatility, round(CASE WHEN volatility > 0 THEN momentum / volatility ELSE 0 END::DOUBLE, 6) AS value,
  CASE WHEN first THEN 'neutral' WHEN momentum > 0 AND abs(momentum) > volatility * 0.5 THEN 'up' WHEN momentum < 0 AND abs(momentum) > volatility * 0.5 THEN 'down' ELSE 'neutral' END AS direction FROM v"""


@query(_ATR_SQL)
def atr_trend_filter(spark, sf_dir):
    return indicators.with_trend_filter(_bars(spark, sf_dir)).select(*BAR_KEYS, "momentum", "volatility", "value", "direction")


_RISK = f"{Q.PX_HOURLY}, {Q.RISK_INPUTS}"


def _risk_rows(spark, sf_dir) -> DataFrame:
    rows = indicators.with_risk_inputs(_px_bars(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 8) for c in ("volatility_pct", "kelly", "slippage_pct", "spread_pct")})


@query(f"{_RISK} SELECT exchange, symbol, ts, volatility_pct FROM risk", places=8)
def rolling_volatility(spark, sf_dir):
    return _risk_rows(spark, sf_dir).select(*BAR_KEYS, "volatility_pct")


@query(f"{_RISK} SELECT exchange, symbol, ts, kelly FROM risk", places=8)
def kelly_multiplier(spark, sf_dir):
    return _risk_rows(spark, sf_dir).select(*BAR_KEYS, "kelly")


@query(f"{_RISK} SELECT exchange, symbol, ts, stale FROM risk")
def stale_quotes(spark, sf_dir):
    return _risk_rows(spark, sf_dir).select(*BAR_KEYS, "stale")


# --- order books

_IMBALANCE = "CASE WHEN a + b > 0 THEN (b - a) / (a + b) ELSE 0 END"
_MICRO = "CASE WHEN a + b > 0 THEN (bids[1].price * a + asks[1].price * b) / (a + b) ELSE mid END"


@query(f"""WITH {Q.BOOKS} SELECT id, ts, round(mid, 6) AS mid_price, round(asks[1].price - bids[1].price, 6) AS spread, round({_MICRO}, 6) AS micro_price, round(b, 6) AS bid_volume, round(a, 6) AS ask_volume,
  round(CASE WHEN a + b > 0 THEN worth / (a + b) ELSE mid END, 6) AS vwap, round({_IMBALANCE}, 6) AS imbalance FROM depth""")
def book_metrics(spark, sf_dir):
    return orderbook.with_metrics(views.books(spark, sf_dir)).drop("bids", "asks", "symbol")


@query(f"WITH {Q.BOOKS} SELECT id, round({_IMBALANCE}, 6) AS value, round(b, 6) AS bid_volume, round(a, 6) AS ask_volume, round(a + b, 6) AS total_volume FROM depth")
def book_obi(spark, sf_dir):
    b, a = (orderbook.depth_volume(F.col(c), 5) for c in ("bids", "asks"))
    return views.books(spark, sf_dir).select("id", orderbook.imbalance(F.col("bids"), F.col("asks")).alias("value"), b.alias("bid_volume"), a.alias("ask_volume"), (a + b).alias("total_volume"))


@query(f"WITH {Q.BOOKS} SELECT id, round({_MICRO}, 6) AS value FROM depth")
def book_micro_price(spark, sf_dir):
    return views.books(spark, sf_dir).select("id", orderbook.micro_price(F.col("bids"), F.col("asks")).alias("value"))


def _signalled_books(spark, sf_dir) -> DataFrame:
    w = Series(("symbol",), ("ts", "id")).window
    return views.books(spark, sf_dir).withColumn("signal", orderbook.mid_signal(F.col("bids"), F.col("asks"), w))


@query(f"WITH {Q.BOOKS} SELECT id, symbol, CASE WHEN p IS NULL THEN 0.0::DOUBLE WHEN m > p THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS signal FROM (SELECT id, symbol, round(mid, 10) AS m, lag(round(mid, 10)) OVER (PARTITION BY symbol ORDER BY ts, id) AS p FROM depth)")
def l2_signals(spark, sf_dir):
    return _signalled_books(spark, sf_dir).select("id", "symbol", "signal")


_DEPTH_FILL = f"""WITH {Q.BOOKS}, lv AS (SELECT id, asks[1].price AS best, unnest(range(1, 9)) AS i, asks FROM books),
w AS (SELECT id, i, asks[i].price AS p, asks[i].size AS q, asks[i].price <= best * 1.001 AS inside FROM lv),
c AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, min(inside::INT) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS go FROM w),
t AS (SELECT id, CASE WHEN go = 1 THEN greatest(0, least(q, 5 - before)) ELSE 0 END AS take, p FROM c)
SELECT id, round(sum(take), 6) AS filled, round(CASE WHEN sum(take) > 0 THEN sum(take * p) / sum(take) ELSE 0 END, 6) AS price FROM t GROUP BY id"""


@query(_DEPTH_FILL)
def depth_fill(spark, sf_dir):
    got = orderbook.depth_fill(F.col("bids"), F.col("asks"), "buy", F.lit(5.0), F.lit(0.0), max_slippage=0.001)
    return views.books(spark, sf_dir).select("id", got.alias("got")).select("id", "got.filled", "got.price")


# --- costs and risk

_VENUE = ["kraken", "firi", "sandbox"]


def _venue():
    return F.element_at(F.array(*map(F.lit, _VENUE)), (F.length("exchange") % 3 + 1).cast("int"))


_VENUE_SQL = "['kraken','firi','sandbox'][(length(exchange) % 3 + 1)::INT]"
_FEE_SQL = "CASE {0} WHEN 'kraken' THEN 0.40::DOUBLE WHEN 'firi' THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END"


@query(f"""{Q.PX_HOURLY}, t AS (SELECT *, {_VENUE_SQL} AS venue, CASE WHEN close > open THEN 1 ELSE -1 END::DOUBLE AS sign FROM bars)
SELECT venue AS exchange, symbol, ts, CASE WHEN sign > 0 THEN 'buy' ELSE 'sell' END AS side, round((close + sign * close * ({_FEE_SQL.format('venue')} / 100.0) * 0.5) * (1 + sign * 10.0 / 10000.0), 10) AS effective_price, exchange AS feed FROM t""", places=10)
def effective_price(spark, sf_dir):
    rows = _px_bars(spark, sf_dir).select(_venue().alias("exchange"), "symbol", "ts", F.when(F.col("close") > F.col("open"), "buy").otherwise("sell").alias("side"), F.col("close").alias("price"), F.lit(0.5).alias("size"), F.col("exchange").alias("feed"))
    return costs.with_effective_price(rows).drop("price", "size")


def _gate_rows(spark, sf_dir) -> DataFrame:
    v = F.col("volume").cast("long")
    return _risk_rows(spark, sf_dir).select(
        F.col("exchange").alias("feed"), _venue().alias("exchange"), "symbol", "ts", "slippage_pct", "spread_pct", "stale", "volatility_pct", "kelly",
        F.lit(1000.0).alias("equity"), (1000.0 + v % 40).alias("peak_equity"), F.when(v % 7 == 0, 1.0).otherwise(0.0).alias("position"), (v % 5).cast("int").alias("open_positions"),
        (v % 3).cast("int").alias("venue_open_positions"), (v % 4).cast("int").alias("open_orders"), (v * 30 % 3000).cast("double").alias("venue_notional"), (v % 10 / 10.0).alias("inventory_skew"),
        F.when(F.col("close") > F.col("open"), "buy").otherwise("sell").alias("signal_side"), (v % 53 == 0).alias("hard_stop"), (v % 47 == 0).alias("breaker"),
    )


_GATE_SQL = f"""{_RISK}, g AS (
  SELECT exchange AS feed, {_VENUE_SQL} AS exchange, symbol, ts, slippage_pct, spread_pct, stale, volatility_pct, kelly, 1000.0::DOUBLE AS equity, (1000 + v % 40)::DOUBLE AS peak, CASE WHEN v % 7 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS position,
    v % 5 AS open_positions, v % 3 AS venue_open, v % 4 AS open_orders, (v * 30 % 3000)::DOUBLE AS used, (v % 10)::DOUBLE / 10.0 AS skew, close > open AS is_buy, v % 53 = 0 AS hard_stop, v % 47 = 0 AS breaker
  FROM (SELECT *, volume::BIGINT AS v FROM risk)),
caps AS (SELECT * FROM (VALUES ('kraken', 0.5::DOUBLE, 500.0::DOUBLE, 2500.0::DOUBLE, 1, 2), ('firi', 0.35, 400.0, 2000.0, 1, 2), ('sandbox', 1.0, 1000.0, 5000.0, 3, 5)) t(exchange, lim, per_trade, total, max_pos, max_orders)),
d AS (SELECT g.*, caps.* EXCLUDE (exchange), greatest(0.0, (peak - equity) / peak) AS down FROM g JOIN caps USING (exchange)),
e AS (SELECT *, CASE WHEN hard_stop THEN 'hard_stop' WHEN breaker THEN 'circuit_breaker' WHEN position <> 0 THEN 'position_open' WHEN slippage_pct > 0.03 THEN 'slippage_limit' WHEN spread_pct > 0.03 THEN 'spread_limit'
    WHEN down > 0.25 THEN 'drawdown_limit' WHEN down > 0.02 THEN 'hard_stop_drawdown' WHEN open_positions >= 3 THEN 'position_limit' WHEN venue_open >= max_pos THEN 'exchange_position_limit' WHEN open_orders >= max_orders THEN 'open_order_limit'
    WHEN total > 0 AND used >= total THEN 'exchange_notional_limit' WHEN volatility_pct > 0.1 THEN 'volatility_limit' END AS reason,
    CASE WHEN volatility_pct <= 0 THEN lim ELSE least(lim, 0.02::DOUBLE / volatility_pct) * kelly END AS base, (greatest(0.0::DOUBLE, skew) - 0.5) / 0.5 AS over FROM d),
f AS (SELECT *, CASE WHEN base <= 0 THEN 0.0 WHEN is_buy AND over > 0 THEN greatest(0.0, base * (1.0 - least(1.0, over * 0.5))) ELSE base END AS pen FROM e),
h AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 0.0 ELSE greatest(0.0, least(lim, CASE WHEN pen <= 0 THEN 0.0 WHEN used > per_trade THEN 0.0 WHEN total - used <= 0 THEN 0.0 ELSE least(pen, (total - used) / greatest(1.0, equity)) END)) END AS position_size FROM f)"""


@query(f"{_GATE_SQL} SELECT feed, exchange, symbol, ts, reason IS NULL AS allowed, round(position_size::DOUBLE, 6) AS position_size, reason FROM h")
def risk_decisions(spark, sf_dir):
    return risk.decide(_gate_rows(spark, sf_dir)).select("feed", "exchange", "symbol", "ts", "allowed", "position_size", "reason")


@query(f"{_GATE_SQL} SELECT coalesce(reason, 'allowed') AS reason, count(*) AS n FROM h GROUP BY 1")
def risk_reason_histogram(spark, sf_dir):
    return risk.decide(_gate_rows(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("allowed")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"{_GATE_SQL} SELECT feed, symbol, ts, round(greatest(0.0, least(1.0, position_size, 50.0 / 100.0, equity * 0.02 / 100.0))::DOUBLE, 6) AS order_size FROM h")
def order_sizes(spark, sf_dir):
    rows = risk.decide(_gate_rows(spark, sf_dir))
    return rows.select("feed", "symbol", "ts", risk.order_size(F.lit(1.0), F.col("position_size"), F.lit(50.0), F.col("equity"), F.lit(100.0), 0.02).alias("order_size"))


_OWN_REASON = "CASE WHEN reason IS NOT NULL THEN reason WHEN skew >= 0.9 THEN 'skew_rule' WHEN kelly < 0.3 THEN 'kelly_rule' END"


@query(
    f"{_GATE_SQL}, o AS (SELECT * EXCLUDE (reason), {_OWN_REASON} AS reason FROM h) SELECT feed, exchange, symbol, ts, reason IS NULL AS allowed, round((CASE WHEN reason IS NOT NULL THEN 0.0 WHEN is_buy THEN position_size ELSE position_size / 2 END)::DOUBLE, 6) AS position_size, reason FROM o"
)
def own_risk_rules(spark, sf_dir):
    """The gate with two rules of the user's own, and half the size for sells."""
    rules = [(F.col("inventory_skew") >= 0.9, "skew_rule"), (F.col("kelly") < 0.3, "kelly_rule")]
    half = lambda size: F.when(F.col("signal_side") == "sell", size / 2).otherwise(size)
    return risk.decide(_gate_rows(spark, sf_dir), rules=rules, sizing=half).select("feed", "exchange", "symbol", "ts", "allowed", "position_size", "reason")


_WORDS = "CASE WHEN lower(trim({0})) IN ('buy','long','1','true','enter') THEN 1.0::DOUBLE WHEN lower(trim({0})) IN ('sell','short','-1','false','exit') THEN -1.0::DOUBLE ELSE coalesce(try_cast(lower(trim({0})) AS DOUBLE), 0.0::DOUBLE) END"
_RAW_SIGNAL = "CASE k % 6 WHEN 0 THEN ' Buy' WHEN 1 THEN 'SHORT' WHEN 2 THEN '-1' WHEN 3 THEN k::VARCHAR WHEN 4 THEN 'hold' ELSE 'enter' END"
_RAW_STATUS = "CASE k % 6 WHEN 0 THEN 'Closed' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'partial' WHEN 3 THEN 'active' WHEN 4 THEN 'strange' ELSE ' FILLED ' END"


@query(f"""SELECT event_id AS id, {_WORDS.format('s')} AS signal, CASE WHEN t IN ('filled','closed','complete','completed') THEN 'FILLED' WHEN t IN ('partially_filled','partially-filled','partial') THEN 'PARTIALLY_FILLED' WHEN t IN ('canceled','cancelled','cancel') THEN 'CANCELED' WHEN t IN ('open','pending','submitted','active') THEN 'OPEN' ELSE 'SUBMITTED' END AS status
FROM (SELECT event_id, {_RAW_SIGNAL} AS s, lower(trim({_RAW_STATUS})) AS t FROM (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events))""")
def normalized_words(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    pick = lambda *words: F.element_at(F.array(*(w if not isinstance(w, str) else F.lit(w) for w in words)), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), S.normalize_signal(pick(" Buy", "SHORT", "-1", k.cast("string"), "hold", "enter")).alias("signal"), S.normalize_status(pick("Closed", "cancelled", "partial", "active", "strange", " FILLED ")).alias("status"))


# --- trades, equity and reports

_TRIP_COLUMNS = "pair, k, entry_time, exit_time, " + _rounded("entry_price", "exit_price", "size", "total_fees", "gross_pnl", "net_pnl", places=8)


def _trips(spark, sf_dir) -> DataFrame:
    return trades.round_trips(views.fills(spark, sf_dir), ["pair"], ["ts", "id"])


@query(f"WITH {Q.TRIPS} SELECT {_TRIP_COLUMNS} FROM trips", places=8)
def round_trips(spark, sf_dir):
    return _trips(spark, sf_dir).select("pair", F.col("k").cast("long").alias("k"), "entry_time", "exit_time", "entry_price", "exit_price", "size", "total_fees", "gross_pnl", "net_pnl")


@query(f"""WITH {Q.TRIPS} SELECT pair, count(*) AS round_trips, count(CASE WHEN net_pnl > 0 THEN 1 END) AS wins, count(CASE WHEN net_pnl <= 0 THEN 1 END) AS losses, round(count(CASE WHEN net_pnl > 0 THEN 1 END) / count(*), 4) AS win_rate,
  round(sum(gross_pnl), 4) AS gross_pnl, round(sum(total_fees), 4) AS total_fees, round(sum(net_pnl), 4) AS net_pnl, round(avg(net_pnl), 4) AS avg_pnl FROM trips GROUP BY pair""", places=4)
def round_trip_stats(spark, sf_dir):
    return trades.round_trip_stats(_trips(spark, sf_dir), ["pair"])


_OPEN = f"WITH {Q.TRIPS}, closed AS (SELECT pair, count(*) AS n FROM numbered WHERE side = 'sell' GROUP BY pair), open_ AS (SELECT b.pair, ts, round(price, 8) AS price, round(size, 8) AS size, round(fee, 8) AS fee, k FROM numbered b LEFT JOIN closed c ON b.pair = c.pair WHERE side = 'buy' AND k > coalesce(n, 0))"


def _open(spark, sf_dir) -> DataFrame:
    return trades.open_positions(views.fills(spark, sf_dir), ["pair"], ["ts", "id"]).withColumn("k", F.col("k").cast("long"))


@query(f"{_OPEN} SELECT * FROM open_", places=8)
def open_positions(spark, sf_dir):
    return _open(spark, sf_dir)


@query(f"{_OPEN} SELECT * FROM open_ ORDER BY ts DESC, pair DESC, k DESC LIMIT 50", places=8)
def latest_open_buys(spark, sf_dir):
    """A report's list of the newest buys that no sell has closed."""
    return trades.latest_open(_open(spark, sf_dir), 50, ["ts", "pair", "k"])


@query(f"WITH {Q.FILLS}, s AS (SELECT *, sum(CASE WHEN side = 'buy' THEN size ELSE -size END) OVER w AS s, sum(CASE WHEN side = 'buy' THEN -(price * size + fee) ELSE price * size - fee END) OVER w AS bal FROM fills WINDOW w AS (PARTITION BY pair ORDER BY {Q._FILL_ORDER} ROWS UNBOUNDED PRECEDING)), m AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY pair ORDER BY {Q._FILL_ORDER} ROWS UNBOUNDED PRECEDING)) AS position FROM s) SELECT pair, max(position) AS top_position, round(sum(position), 2) AS position_sum, round(min(bal), 2) AS low_balance, count(*) AS fills FROM m GROUP BY pair", places=2)
def account_state(spark, sf_dir):
    state = folds.account_state(views.fills(spark, sf_dir), ["pair"], ["ts", "id"])
    return state.groupBy("pair").agg(F.max("position").alias("top_position"), F.sum("position").alias("position_sum"), F.min("balance_change").alias("low_balance"), F.count("*").alias("fills"))


@query(f"""WITH {Q.EQUITY} SELECT source, round(arg_min(equity, (ts, id)), 4) AS start_equity, round(arg_max(equity, (ts, id)), 4) AS end_equity, round(max(equity), 4) AS peak_equity, round(min(equity), 4) AS trough_equity, count(*) AS snapshots,
  round(max(equity) - min(equity), 4) AS max_drawdown, round((max(equity) - min(equity)) / max(equity), 4) AS max_drawdown_pct, round(arg_max(equity, (ts, id)) - arg_min(equity, (ts, id)), 4) AS total_pnl FROM equity GROUP BY source""", places=4)
def equity_stats(spark, sf_dir):
    return analytics.equity_stats(views.equity(spark, sf_dir), ["source"])


@query(f"""WITH {Q.EQUITY}, {Q.OP_EVENTS}, t AS (SELECT l_shipdate::DATE AS d, count(*) AS total_trades FROM lineitem GROUP BY 1), a AS (SELECT ts::DATE AS d, count(*) AS alert_count FROM op WHERE event_type = 'runtime_alert' GROUP BY 1),
e0 AS (SELECT ts::DATE AS d, arg_max(equity, (ts, id)) AS ending, max(equity) AS peak, min(equity) AS trough FROM equity GROUP BY 1), e AS (SELECT *, coalesce(lag(ending) OVER (ORDER BY d), 1000.0) AS starting FROM e0)
SELECT d AS report_date, coalesce(total_trades, 0) AS total_trades, round(coalesce(starting, 1000.0), 4) AS starting_equity, round(coalesce(ending, 1000.0), 4) AS ending_equity, round(coalesce(ending, 1000.0) - coalesce(starting, 1000.0), 4) AS total_pnl,
  round(coalesce(greatest(0.0, peak - trough), 0.0), 4) AS max_drawdown, round(CASE WHEN peak > 0 THEN (peak - trough) / peak ELSE 0.0 END, 4) AS max_drawdown_pct, coalesce(alert_count, 0) AS alert_count
FROM e FULL JOIN t USING (d) FULL JOIN a USING (d)""", places=4)
def daily_summary(spark, sf_dir):
    return reports.daily_summary(views.fills(spark, sf_dir), views.equity(spark, sf_dir), views.op_events(spark, sf_dir))


_UP_TO = "OVER (PARTITION BY source ORDER BY ts, id ROWS UNBOUNDED PRECEDING)"


@query(f"WITH {Q.EQUITY} SELECT id, source, round(equity, 4) AS equity, round(max(equity) {_UP_TO}, 4) AS peak, round((max(equity) {_UP_TO} - equity) / max(equity) {_UP_TO}, 4) AS drawdown, round(min(equity) {_UP_TO}, 4) AS trough FROM equity", places=4)
def running_drawdown(spark, sf_dir):
    return analytics.with_running_drawdown(views.equity(spark, sf_dir), ["source"], ["ts", "id"]).select("id", "source", "equity", "peak", "drawdown", "trough")


@query(f"""WITH {Q.EQUITY}, r AS (SELECT *, equity / nullif(lag(equity) OVER (PARTITION BY source ORDER BY ts, id), 0) - 1.0 AS ret FROM equity),
m AS (SELECT source, avg(ret) AS mu, stddev_pop(ret) AS sd, count(ret) AS n, stddev_pop(CASE WHEN ret < 0 THEN ret END) AS dn, count(CASE WHEN ret > 0 THEN 1 END) AS wins, sum(CASE WHEN ret > 0 THEN ret END) AS gains, sum(CASE WHEN ret < 0 THEN -ret END) AS losses, avg(CASE WHEN ret > 0 THEN ret END) AS g, avg(CASE WHEN ret < 0 THEN -ret END) AS l FROM r GROUP BY source)
SELECT source, round(mu / sd * sqrt(n), 4) AS sharpe_ratio, round(mu / dn * sqrt(n), 4) AS sortino_ratio, n AS trades, round(wins / n, 4) AS win_rate, round(gains / losses, 4) AS profit_factor, round(wins / n * g - (1 - wins / n) * l, 4) AS expectancy, round(mu, 4) AS avg_trade_return, round(g, 4) AS avg_win, round(l, 4) AS avg_loss FROM m""", places=4)
def returns_metrics(spark, sf_dir):
    ret = F.col("ret")
    rows = analytics.with_periodic_returns(views.equity(spark, sf_dir), ["source"], ["ts", "id"])
    return rows.groupBy("source").agg(analytics.sharpe(ret).alias("sharpe_ratio"), analytics.sortino(ret).alias("sortino_ratio"), *(c.alias(n) for n, c in analytics.trade_metrics(ret).items()))


@query(f"WITH {Q.EQUITY}, w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, id DESC) AS place, max(ts) OVER (PARTITION BY source) AS newest FROM equity) SELECT source, round(arg_max(equity, (ts, id)) - arg_min(equity, (ts, id)), 4) AS pnl_last_hour, count(*) AS snapshots FROM w WHERE place <= 200 AND epoch_us(newest) - epoch_us(ts) <= 3600000000 GROUP BY source", places=4)
def pnl_last_hour(spark, sf_dir):
    return analytics.pnl_last_hour(views.equity(spark, sf_dir), ["source"])


@query(f"WITH {Q.EQUITY} SELECT source, round(arg_max(equity, (ts, id)) - 1000.0, 4) AS current_pnl, round((max(equity) - arg_max(equity, (ts, id))) / max(equity), 4) AS current_drawdown, round(arg_max(equity, (ts, id)) - min(equity), 4) AS above_worst FROM equity GROUP BY source", places=4)
def update_metrics(spark, sf_dir):
    return analytics.update_metrics(views.equity(spark, sf_dir), ["source"], 1000.0)


@query(f"WITH {Q.OP_EVENTS} SELECT event_type, reason, count(*) AS n FROM dec WHERE (event_type = 'entry_decision' AND NOT allowed) OR (event_type = 'order_lifecycle' AND status = 'CANCELED') GROUP BY ALL")
def event_reason_counts(spark, sf_dir):
    return reports.reason_counts(views.op_events(spark, sf_dir))


@query(f"WITH {Q.OP_EVENTS}, p AS (SELECT source, reason, count(*) AS n, min(id) AS first FROM dec WHERE event_type = 'entry_decision' AND NOT allowed GROUP BY ALL) SELECT source, reason, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS place FROM p) WHERE place = 1")
def no_trade_reason(spark, sf_dir):
    return reports.no_trade_reason(views.op_events(spark, sf_dir), ["source"])


@query(f"WITH {Q.OP_EVENTS}, p AS (SELECT source, reason, count(*) AS n, count(CASE WHEN allowed THEN 1 END) AS ok FROM dec WHERE event_type = 'entry_decision' GROUP BY ALL) SELECT source, sum(n)::BIGINT AS total, sum(ok)::BIGINT AS allowed, sum(n - ok)::BIGINT AS blocked, string_agg(CASE WHEN n > ok THEN reason || '=' || (n - ok) END, ',' ORDER BY reason) AS reasons FROM p GROUP BY source")
def decision_summary(spark, sf_dir):
    out = reports.decision_summary(views.op_events(spark, sf_dir), ["source"])
    return out.withColumn("reasons", F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query("SELECT o_orderdate::DATE AS report_date, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS id, round(max(o_totalprice), 4) AS equity FROM orders GROUP BY 1", places=4)
def upsert_latest(spark, sf_dir):
    rows = views.equity(spark, sf_dir).select(F.to_date("ts").alias("report_date"), "id", "equity")
    return reports.upsert_latest(rows, ["report_date"], ["equity", "id"])


@query("WITH s AS (SELECT event_id AS id, event_type AS source, value > 100 AS active, coalesce(lag(value > 100) OVER (PARTITION BY event_type ORDER BY ts, event_id), false) AS before FROM events) SELECT id, source, active, CASE WHEN active THEN 'raised' ELSE 'cleared' END AS edge FROM s WHERE active <> before")
def alert_edges(spark, sf_dir):
    states = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), "ts", (F.col("value") > 100).alias("active"))
    return reports.alert_edges(states, ["source"], ["ts", "id"]).drop("ts")


@query(f"{Q.HOURLY} SELECT exchange, symbol, max(ts) AS newest, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 1e6, 4) AS age_seconds, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 1e6 > 10800 AS stale FROM bars GROUP BY ALL", places=4)
def stale_feeds(spark, sf_dir):
    return reports.stale_feeds(_bars(spark, sf_dir), PAIR, F.lit("2024-02-01").cast("timestamp"), bar_seconds=3600)


@query(f"WITH {Q.TICKS}, {Q.EQUITY}, q AS (SELECT arg_max(last, (ts, id)) AS mark FROM ticks WHERE symbol = 'BTC/NOK'), s AS (SELECT source, arg_max(equity, (ts, id)) AS cash FROM equity GROUP BY source) SELECT source, round(mark, 4) AS mark, round(cash + 2.0 * mark, 4) AS equity, round(2.0 * (mark - 50.0), 4) AS unrealized_pnl FROM s, q", places=4)
def mark_to_market(spark, sf_dir):
    snapshots = views.equity(spark, sf_dir).groupBy("source").agg(F.max_by("equity", F.struct("ts", "id")).alias("cash")).withColumns({"symbol": F.lit("BTC/NOK"), "position_size": F.lit(2.0), "avg_entry_price": F.lit(50.0)})
    return analytics.mark_to_market(snapshots, views.ticks(spark, sf_dir)).select("source", "mark", "equity", "unrealized_pnl")


@query(f"""WITH {Q.EQUITY}, d AS (SELECT source, ts::DATE AS day, min(ts) AS first FROM equity GROUP BY ALL), e AS (SELECT source, ts, arg_max(equity, id) AS equity FROM equity GROUP BY ALL)
SELECT d.source, d.day, d.first, e.ts AS previous, round(coalesce(e.equity, 1000.0), 4) AS starting FROM d ASOF LEFT JOIN e ON d.source = e.source AND e.ts < d.first""", places=4)
def previous_day_equity(spark, sf_dir):
    """What each source had before each of its days."""
    return analytics.starting_equity(views.equity(spark, sf_dir), ["source"])


@query(f"""WITH {Q.TICKS}, q AS (SELECT symbol, ts, arg_max(last, id) AS mark FROM ticks WHERE id % 5 <> 0 GROUP BY ALL), s AS (SELECT id, symbol, ts, (id % 7 + 1)::DOUBLE AS held FROM ticks WHERE id % 5 = 0),
j AS (SELECT s.*, CASE WHEN epoch_us(s.ts) - epoch_us(q.ts) <= 600000000 THEN q.ts END AS quoted, CASE WHEN epoch_us(s.ts) - epoch_us(q.ts) <= 600000000 THEN mark END AS mark FROM s ASOF LEFT JOIN q ON s.symbol = q.symbol AND q.ts <= s.ts)
SELECT id, symbol, ts, quoted, round(mark, 4) AS mark, round(1000.0 + held * coalesce(mark, 0.0), 4) AS equity, round(held * (mark - 50.0), 4) AS unrealized_pnl FROM j""", places=4)
def snapshot_marks(spark, sf_dir):
    """Snapshots, each marked at the newest quote of the ten minutes before it."""
    ticks = views.ticks(spark, sf_dir)
    snapshots = ticks.where("id % 5 = 0").select("id", "symbol", "ts", F.lit(1000.0).alias("cash"), (F.col("id") % 7 + 1).cast("double").alias("position_size"), F.lit(50.0).alias("avg_entry_price"))
    return analytics.marks_at(snapshots, ticks.where("id % 5 != 0"), 600).select("id", "symbol", "ts", "quoted", "mark", "equity", "unrealized_pnl")


_CURVE = "c AS (SELECT event_id AS id, event_type AS source, ts, value AS equity FROM events)"


def _curve(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("equity"))


@query(f"""WITH {_CURVE}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, id) AS n FROM c)
SELECT a.id, a.source, a.ts, round(a.equity, 4) AS equity, round(a.equity - arg_min(b.equity, b.n), 4) AS pnl, min(b.ts) AS oldest FROM n a JOIN n b ON a.source = b.source AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) - 21600000000 AND epoch_us(a.ts) AND b.n <= a.n GROUP BY a.id, a.source, a.ts, a.equity""", places=4)
def trailing_pnl(spark, sf_dir):
    """The gain of the six hours before every snapshot, over all of them."""
    return analytics.trailing_pnl(_curve(spark, sf_dir), ["source"], seconds=6 * 3600)


@query(f"""WITH {_CURVE}, w AS (SELECT *, make_timestamp((epoch_us(ts) // 900000000 - k) * 900000000) AS start FROM c, (SELECT unnest(range(0, 4)) AS k))
SELECT source, start, start + INTERVAL 1 HOUR AS "end", round(arg_max(equity, (ts, id)) - arg_min(equity, (ts, id)), 4) AS pnl, round(max(equity), 4) AS peak, round(min(equity), 4) AS trough, count(*) AS snapshots FROM w GROUP BY source, start""", places=4)
def window_pnl(spark, sf_dir):
    """Gains of hours that begin every quarter."""
    return analytics.window_pnl(_curve(spark, sf_dir), ["source"])


@query(f"""WITH {Q.TICKS}, g AS (SELECT exchange, symbol, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY exchange, symbol ORDER BY ts) AS after FROM ticks),
s AS (SELECT * FROM g WHERE coalesce(after, epoch_us(TIMESTAMP '2024-02-01')) - t > 14400000000)
SELECT exchange, symbol, make_timestamp(t + 14400000000) AS at, 'raised' AS edge FROM s UNION ALL SELECT exchange, symbol, make_timestamp(after), 'cleared' FROM s WHERE after - t <= 36000000000""")
def stale_edges(spark, sf_dir):
    """Feeds that were silent for four hours, and the ticks that ended it within six more."""
    return reports.stale_edges(views.ticks(spark, sf_dir), PAIR, 4 * 3600, F.lit("2024-02-01").cast("timestamp"), 6 * 3600)


# --- reconciliation


def _balances(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    def side(name: str, key: str, amount: str) -> DataFrame:
        return table(spark, sf_dir, name).groupBy(F.col(key).alias("key")).agg(F.round(F.sum(amount), 2).alias("amount"))

    return side("customer", "c_nationkey", "c_acctbal"), side("supplier", "s_nationkey", "s_acctbal")


_BALANCES = "l AS (SELECT c_nationkey AS key, round(sum(c_acctbal), 2) AS amount FROM customer GROUP BY 1), r AS (SELECT s_nationkey AS key, round(sum(s_acctbal), 2) AS amount FROM supplier GROUP BY 1), bal AS (SELECT key, l.amount AS local_amount, r.amount AS remote_amount, l.amount IS NOT DISTINCT FROM r.amount AS matched, coalesce(r.amount, l.amount) AS merged_amount FROM l FULL JOIN r USING (key))"


@query(f"WITH {_BALANCES} SELECT * FROM bal", places=2)
def reconcile_balances(spark, sf_dir):
    return reconcile.reconcile_balances(*_balances(spark, sf_dir))


def _orders(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    names = {"F": "FILLED", "O": "OPEN", "P": "PARTIALLY_FILLED"}
    word = lambda c: F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[c]
    local = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), word(F.col("o_orderstatus")).alias("status"), F.lit(0.0).alias("filled_size"), F.lit(None).cast("double").alias("fill_price"), F.lit(0.0).alias("fee"))
    remote = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.when(F.min("l_linestatus") == "O", "OPEN").otherwise("FILLED").alias("status"), F.sum("l_quantity").alias("filled_size"), F.max("l_extendedprice").alias("fill_price"), F.min("l_tax").alias("fee"))
    return local, remote


_ORDERS = """lo AS (SELECT o_orderkey AS order_id, CASE o_orderstatus WHEN 'F' THEN 'FILLED' WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'PARTIALLY_FILLED' END AS status, 0.0::DOUBLE AS filled_size, NULL::DOUBLE AS fill_price, 0.0::DOUBLE AS fee FROM orders),
ro AS (SELECT l_orderkey AS order_id, CASE WHEN min(l_linestatus) = 'O' THEN 'OPEN' ELSE 'FILLED' END AS status, sum(l_quantity) AS filled_size, max(l_extendedprice) AS fill_price, min(l_tax) AS fee FROM lineitem GROUP BY 1),
ord AS (SELECT lo.order_id, CASE WHEN ro.order_id IS NULL THEN 'NOT_FOUND' ELSE ro.status END AS remote_status, lo.status AS local_status, lo.status IS NOT DISTINCT FROM (CASE WHEN ro.order_id IS NULL THEN 'NOT_FOUND' ELSE ro.status END) AND lo.filled_size IS NOT DISTINCT FROM ro.filled_size AND lo.fill_price IS NOT DISTINCT FROM ro.fill_price AND lo.fee IS NOT DISTINCT FROM ro.fee AS matched,
  coalesce(CASE WHEN ro.order_id IS NULL THEN 'NOT_FOUND' ELSE ro.status END, lo.status) AS status, coalesce(ro.filled_size, lo.filled_size) AS filled_size, coalesce(ro.fill_price, lo.fill_price) AS fill_price, coalesce(ro.fee, lo.fee) AS fee FROM lo LEFT JOIN ro USING (order_id))"""


@query(f"WITH {_ORDERS} SELECT order_id, local_status, remote_status, matched, status, round(filled_size, 4) AS filled_size, round(fill_price, 4) AS fill_price, round(fee, 4) AS fee, status NOT IN ('FILLED','CANCELED','REJECTED','NOT_FOUND') AS pending FROM ord", places=4)
def reconcile_orders(spark, sf_dir):
    return reconcile.reconcile_orders(*_orders(spark, sf_dir)).select("order_id", "local_status", "remote_status", "matched", "status", "filled_size", "fill_price", "fee", "pending")


@query(f"WITH {_BALANCES}, {_ORDERS} SELECT o.*, (SELECT count(*) FROM bal WHERE NOT matched) AS mismatched_balances, CASE WHEN mismatched_orders = 0 AND (SELECT count(*) FROM bal WHERE NOT matched) = 0 THEN 'matched' ELSE 'mismatched' END AS status FROM (SELECT count(*) AS orders, count(CASE WHEN status NOT IN ('FILLED','CANCELED','REJECTED','NOT_FOUND') THEN 1 END) AS pending_orders, count(CASE WHEN matched THEN 1 END) AS matched_orders, count(CASE WHEN NOT matched THEN 1 END) AS mismatched_orders FROM ord) o")
def account_summary(spark, sf_dir):
    return reconcile.account_summary(reconcile.reconcile_balances(*_balances(spark, sf_dir)), reconcile.reconcile_orders(*_orders(spark, sf_dir)))


@query(f"WITH {_BALANCES}, {_ORDERS} SELECT 'balance' AS kind, key::VARCHAR AS key, round(local_amount, 2) AS local_amount, round(remote_amount, 2) AS remote_amount, NULL AS local_status, NULL AS remote_status FROM bal WHERE NOT matched UNION ALL SELECT 'order', order_id::VARCHAR, NULL, NULL, local_status, remote_status FROM ord WHERE NOT matched", places=2)
def account_mismatches(spark, sf_dir):
    found = reconcile.mismatches(reconcile.reconcile_balances(*_balances(spark, sf_dir)), reconcile.reconcile_orders(*_orders(spark, sf_dir)))
    amount, status = F.col("kind") == "balance", F.col("kind") == "order"
    return found.select("kind", "key", *(F.when(amount, F.col(c)).cast("double").alias(f"{c}_amount") for c in ("local", "remote")), *(F.when(status, F.col(c)).alias(f"{c}_status") for c in ("local", "remote")))


def _venue_orders(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two of three orders as local ones; the venue's view is their line items', its status missing for some."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    local = o.where(k % 3 != 0).select(
        (F.col("o_custkey") % 20).alias("account"), k.alias("order_id"), F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"), (k % 50 + 1).cast("double").alias("size"), (100.0 + k % 7).alias("price"),
        F.when(F.col("o_orderstatus") == "F", "FILLED").when(F.col("o_orderstatus") == "P", "PARTIALLY_FILLED").otherwise("SUBMITTED").alias("status"), F.when(F.col("o_orderstatus") != "O", (k % 30).cast("double")).alias("filled_size"), F.lit(None).cast("double").alias("fill_price"), F.when(k % 5 != 0, 0.25).alias("fee"),
    )
    key = F.col("l_orderkey")
    remote = table(spark, sf_dir, "lineitem").groupBy(key.alias("order_id")).agg(F.min("l_linestatus").alias("line"), F.sum("l_quantity").alias("q"), F.min("l_tax").alias("tax"))
    key = F.col("order_id")
    status = F.when(key % 11 == 0, "").when(F.col("line") == "F", "filled").otherwise("open")
    return local, remote.select(key, key.alias("seq"), F.when(key % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("q").alias("size"), status.alias("status"), F.when(key % 4 != 0, F.col("q")).alias("filled_size"), F.when(key % 9 != 0, 100.0 + key % 13).alias("fill_price"), F.when(key % 6 != 0, F.col("tax")).alias("fee"))


_VENUE_ORDERS = """lo AS (SELECT o_custkey % 20 AS account, o_orderkey AS order_id, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, (o_orderkey % 50 + 1)::DOUBLE AS size, (100 + o_orderkey % 7)::DOUBLE AS price,
  CASE o_orderstatus WHEN 'F' THEN 'FILLED' WHEN 'P' THEN 'PARTIALLY_FILLED' ELSE 'SUBMITTED' END AS status, CASE WHEN o_orderstatus <> 'O' THEN (o_orderkey % 30)::DOUBLE END AS filled_size, CASE WHEN o_orderkey % 5 <> 0 THEN 0.25::DOUBLE END AS fee FROM orders WHERE o_orderkey % 3 <> 0),
ro AS (SELECT k AS order_id, CASE WHEN k % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, q AS size, CASE WHEN k % 11 = 0 THEN NULL WHEN line = 'F' THEN 'FILLED' ELSE 'OPEN' END AS status, CASE WHEN k % 4 <> 0 THEN q END AS filled_size, CASE WHEN k % 9 <> 0 THEN (100 + k % 13)::DOUBLE END AS fill_price, CASE WHEN k % 6 <> 0 THEN tax END AS fee
  FROM (SELECT l_orderkey AS k, min(l_linestatus) AS line, sum(l_quantity) AS q, min(l_tax) AS tax FROM lineitem GROUP BY 1))"""


@query(f"""WITH {_VENUE_ORDERS} SELECT coalesce(lo.order_id, ro.order_id) AS order_id, coalesce(lo.side, ro.side) AS side, coalesce(lo.size, ro.size) AS size, coalesce(ro.status, lo.status, 'SUBMITTED') AS status, round(coalesce(ro.filled_size, lo.filled_size), 4) AS filled_size,
  ro.fill_price, round(coalesce(ro.fee, lo.fee, CASE WHEN lo.order_id IS NULL THEN 0.0 END)::DOUBLE, 4) AS fee, ro.order_id IS NOT NULL AS recovered, lo.order_id IS NULL AS inserted FROM lo FULL JOIN ro ON lo.order_id = ro.order_id""", places=4)
def recovered_orders(spark, sf_dir):
    return reconcile.recover_orders(*_venue_orders(spark, sf_dir))


@query(f"""WITH {_VENUE_ORDERS}, d AS (SELECT lo.account, lo.order_id, lo.side, coalesce(ro.filled_size, CASE WHEN lo.status IN ('FILLED', 'PARTIALLY_FILLED') THEN 0.0 ELSE lo.size END) - coalesce(lo.filled_size, 0.0) AS delta, coalesce(ro.fill_price, lo.price) AS price, greatest(0.0, coalesce(ro.fee, 0.0) - coalesce(lo.fee, 0.0)) AS fee
  FROM lo JOIN ro USING (order_id) WHERE ro.status IN ('FILLED', 'PARTIALLY_FILLED')),
p AS (SELECT *, 25.0 + sum(CASE WHEN side = 'buy' THEN delta ELSE -delta END) OVER (PARTITION BY account ORDER BY order_id ROWS UNBOUNDED PRECEDING) AS s FROM d WHERE delta > 0)
SELECT account, round(1000.0 + sum(CASE WHEN side = 'buy' THEN -delta * price - fee ELSE delta * price - fee END), 2) AS balance, round(arg_max(s, order_id) - least(0.0, min(s)), 4) AS position FROM p GROUP BY account""", places=2)
def recovered_accounts(spark, sf_dir):
    local, remote = _venue_orders(spark, sf_dir)
    start = local.select("account").distinct().withColumns({"balance": F.lit(1000.0), "position": F.lit(25.0)})
    return reconcile.apply_fills(reconcile.fill_deltas(local, remote, ["account"]), start, ["account"])


def _order_updates(spark, sf_dir) -> DataFrame:
    """Line items as updates of their order, one after another: more filled with each, and fields left out."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax")
    w = Window.partitionBy("l_orderkey").orderBy(line)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.row_number().over(w).cast("long").alias("seq"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"), F.sum("l_quantity").over(upto).alias("q"), F.sum("l_tax").over(upto).alias("tax"))
    k, seq = F.col("order_id"), F.col("seq")
    status = F.when((k + seq) % 11 == 0, "").when(seq == F.col("n"), "filled").when(seq == 1, "open").otherwise("partially_filled")
    return rows.select((k % 20).alias("account"), k, seq, F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("n").cast("double").alias("size"), status.alias("status"), F.when((k + seq) % 4 != 0, F.col("q")).alias("filled_size"), F.when((k + seq) % 9 != 0, 100.0 + (k + seq) % 13).alias("fill_price"), F.when((k + seq) % 6 != 0, F.round("tax", 4)).alias("fee"))


_UPDATES = f"""{_VENUE_ORDERS}, li AS (SELECT l_orderkey AS k, l_quantity, l_tax, row_number() OVER w AS seq, count(*) OVER (PARTITION BY l_orderkey) AS n, sum(l_quantity) OVER w AS q, sum(l_tax) OVER w AS tax FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax ROWS UNBOUNDED PRECEDING)),
up AS (SELECT k % 20 AS account, k AS order_id, seq, CASE WHEN k % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, n::DOUBLE AS size, CASE WHEN (k + seq) % 11 = 0 THEN NULL WHEN seq = n THEN 'FILLED' WHEN seq = 1 THEN 'OPEN' ELSE 'PARTIALLY_FILLED' END AS status, CASE WHEN (k + seq) % 4 <> 0 THEN q END AS filled_size, CASE WHEN (k + seq) % 9 <> 0 THEN (100 + (k + seq) % 13)::DOUBLE END AS fill_price, CASE WHEN (k + seq) % 6 <> 0 THEN round(tax, 4) END AS fee FROM li),
both_ AS (SELECT order_id, 0 AS seq, account, side, size, price, status, filled_size, NULL::DOUBLE AS fill_price, fee FROM lo UNION ALL SELECT order_id, seq, account, side, size, NULL, status, filled_size, fill_price, fee FROM up),
st AS (SELECT order_id, seq, status, filled_size, fill_price, fee, first_value(account) OVER a AS account, first_value(side) OVER a AS side, first_value(size) OVER a AS size, first_value(price) OVER a AS price, row_number() OVER a = 1 AS first,
  last_value(status IGNORE NULLS) OVER b AS b_status, last_value(filled_size IGNORE NULLS) OVER b AS b_filled, last_value(fee IGNORE NULLS) OVER b AS b_fee FROM both_ WINDOW a AS (PARTITION BY order_id ORDER BY seq), b AS (PARTITION BY order_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dl AS (SELECT * FROM (SELECT account, order_id, seq, side, coalesce(filled_size, CASE WHEN b_status IN ('FILLED', 'PARTIALLY_FILLED') THEN 0.0 ELSE size END) - coalesce(b_filled, 0.0) AS delta, coalesce(fill_price, price, 0.0) AS price, greatest(0.0, coalesce(fee, 0.0) - coalesce(b_fee, 0.0)) AS fee_delta
  FROM st WHERE seq > 0 AND NOT first AND status IN ('FILLED', 'PARTIALLY_FILLED')) WHERE delta > 0)"""


def _updated(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return _venue_orders(spark, sf_dir)[0], _order_updates(spark, sf_dir)


@query(f"WITH {_UPDATES} SELECT account, order_id, seq, side, round(delta, 4) AS delta, round(price, 4) AS price, round(fee_delta, 4) AS fee_delta FROM dl", places=4)
def order_update_fills(spark, sf_dir):
    """What each of an order's updates fills beyond those before it."""
    return reconcile.fill_deltas(*_updated(spark, sf_dir), ["account"])


@query(f"""WITH {_UPDATES} SELECT order_id, arg_min(side, seq) AS side, arg_min(size, seq) AS size, coalesce(arg_max(status, seq) FILTER (status IS NOT NULL), 'SUBMITTED') AS status, round(arg_max(filled_size, seq) FILTER (filled_size IS NOT NULL), 4) AS filled_size, round(arg_max(fill_price, seq) FILTER (fill_price IS NOT NULL), 4) AS fill_price,
  round(coalesce(arg_max(fee, seq) FILTER (fee IS NOT NULL), CASE WHEN min(seq) > 0 THEN 0.0 END)::DOUBLE, 4) AS fee, max(seq) > 0 AS recovered, min(seq) > 0 AS inserted FROM both_ GROUP BY order_id""", places=4)
def updated_orders(spark, sf_dir):
    """Orders after all their updates."""
    return reconcile.recover_orders(*_updated(spark, sf_dir))


_ACCOUNTS = """p AS (SELECT *, sum(CASE WHEN side = 'buy' THEN delta ELSE -delta END) OVER (PARTITION BY account ORDER BY seq, order_id ROWS UNBOUNDED PRECEDING) AS s FROM dl),
h AS (SELECT account, round(1000.0 + sum(CASE WHEN side = 'buy' THEN -delta * price - fee_delta ELSE delta * price - fee_delta END), 2) AS balance, round(25.0 + arg_max(s, (seq, order_id)) - least(0.0, 25.0 + min(s)), 4) AS position FROM p GROUP BY account)"""


@query(f"""WITH {_UPDATES}, {_ACCOUNTS}, r AS (SELECT s_suppkey % 30 AS account, CASE WHEN s_suppkey % 30 % 4 > 0 THEN round(sum(s_acctbal), 2) END AS balance, CASE WHEN s_suppkey % 30 % 3 > 0 THEN count(*)::DOUBLE END AS position FROM supplier GROUP BY s_suppkey % 30)
SELECT account, h.balance AS local_balance, h.position AS local_position, r.balance AS remote_balance, r.position AS remote_position, h.balance IS NOT DISTINCT FROM r.balance AND h.position IS NOT DISTINCT FROM r.position AS matched, coalesce(r.balance, h.balance) AS balance, coalesce(r.position, h.position) AS position FROM h FULL JOIN r USING (account)""", places=2)
def reconnected_accounts(spark, sf_dir):
    """Accounts after a reconnect: updates applied one by one, then the venue's snapshot wins where it says something."""
    local, updates = _updated(spark, sf_dir)
    start = local.select("account").distinct().withColumns({"balance": F.lit(1000.0), "position": F.lit(25.0)})
    key = (F.col("s_suppkey") % 30).alias("account")
    snapshot = table(spark, sf_dir, "supplier").groupBy(key).agg(F.round(F.sum("s_acctbal"), 2).alias("b"), F.count("*").cast("double").alias("p"))
    snapshot = snapshot.select("account", F.when(F.col("account") % 4 > 0, F.col("b")).alias("balance"), F.when(F.col("account") % 3 > 0, F.col("p")).alias("position"))
    return reconcile.recover_accounts(local, updates, start, snapshot, ["account"])


@query(f"""WITH {_VENUE_ORDERS} SELECT account, order_id, CASE WHEN account % 3 = 0 AND status NOT IN ('FILLED', 'CANCELED', 'REJECTED', 'NOT_FOUND') THEN 'CANCELED' ELSE status END AS status, account % 3 = 0 AND status NOT IN ('FILLED', 'CANCELED', 'REJECTED', 'NOT_FOUND') AS stopped FROM lo""")
def kill_switch_orders(spark, sf_dir):
    """Orders after a kill switch on every third account."""
    return reconcile.kill_switch(_venue_orders(spark, sf_dir)[0], F.col("account") % 3 == 0).select("account", "order_id", "status", "stopped")


# --- lists, rates and alerts

_PAIR_SQL = "'C' || {0} || '/NOK'"


@query(f"""WITH r AS (SELECT event_id AS id, json_extract_string(props, '$.k')::BIGINT % 25 AS k, value AS rate FROM events), n AS (SELECT {_PAIR_SQL.format('k')} AS pair, arg_max(rate, id) AS stored FROM r WHERE k % 3 = 0 GROUP BY 1),
w AS (SELECT {_PAIR_SQL.format('n_nationkey')} AS pair, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 1.5 END AS mid FROM nation)
SELECT pair, round(coalesce(stored, mid, 11.5)::DOUBLE, 6) AS rate, CASE WHEN stored IS NOT NULL THEN 'stored' WHEN mid IS NOT NULL THEN 'live' ELSE 'fallback' END AS origin FROM w LEFT JOIN n USING (pair)""")
def fx_rates(spark, sf_dir):
    pair = lambda c: F.concat(F.lit("C"), c.cast("string"), F.lit("/NOK"))
    k = F.get_json_object("props", "$.k").cast("long") % 25
    stored = table(spark, sf_dir, "events").where(k % 3 == 0).select(F.col("event_id").alias("id"), pair(k).alias("pair"), F.col("value").alias("rate"))
    key = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation")
    live = nation.where(key % 2 == 0).select(pair(key).alias("pair"), (key + 1).cast("double").alias("bid"), (key + 2).cast("double").alias("ask"))
    return market.fx_rates(nation.select(pair(key).alias("pair")), stored, live, 11.5)


@query(f"WITH {Q.OP_EVENTS}, c AS (SELECT event_type, reason, count(*) AS n FROM dec WHERE (event_type = 'entry_decision' AND NOT allowed) OR (event_type = 'order_lifecycle' AND status = 'CANCELED') GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, reason) AS place FROM c")
def reason_histogram(spark, sf_dir):
    return reports.ranked_reasons(reports.reason_counts(views.op_events(spark, sf_dir))).withColumn("place", F.col("place").cast("long"))


_LAST = "ORDER BY exit_time DESC, pair DESC, k DESC LIMIT 50"


@query(f"WITH {Q.TRIPS} SELECT {_TRIP_COLUMNS} FROM (SELECT * FROM trips {_LAST})", places=8)
def latest_trips(spark, sf_dir):
    """A report's list of the last closed trades."""
    return trades.latest_trips(_trips(spark, sf_dir), 50, ["exit_time", "pair", "k"]).select("pair", F.col("k").cast("long").alias("k"), "entry_time", "exit_time", "entry_price", "exit_price", "size", "total_fees", "gross_pnl", "net_pnl")


@query("SELECT 'events' AS kind, event_id AS id, ts FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 20) UNION ALL SELECT 'snapshots', o_orderkey, o_orderdate FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 20)")
def latest_log_rows(spark, sf_dir):
    """A report's lists of the newest events and equity snapshots."""
    newest = lambda rows, kind: market.latest(rows, 20).select(F.lit(kind).alias("kind"), "id", "ts")
    return newest(views.op_events(spark, sf_dir), "events").unionByName(newest(views.equity(spark, sf_dir), "snapshots"))


@query(f"{Q.HOURLY} SELECT exchange, symbol, ts, round(close, 6) AS close, CASE WHEN epoch_us(ts) // 3600000000 % 3 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS signal FROM bars")
def outside_signals(spark, sf_dir):
    """Bars with signals that come from elsewhere, one for each bar."""
    bars_ = _bars(spark, sf_dir)
    given = bars_.select(*BAR_KEYS, F.when(F.unix_seconds("ts") / 3600 % 3 == 0, 1.0).otherwise(-1.0).alias("signal"))
    return indicators.with_signals(bars_, given, PAIR).select(*BAR_KEYS, "close", "signal")


@query(f"SELECT event_id AS id, CASE WHEN upper(trim(raw)) = 'CLOSED' THEN 'FILLED' WHEN upper(trim(raw)) IN ('OPEN', 'PENDING') THEN 'OPEN' WHEN upper(trim(raw)) = 'CANCELED' THEN 'CANCELED' ELSE 'SUBMITTED' END AS status FROM (SELECT event_id, CASE k % 6 WHEN 0 THEN 'Closed' WHEN 1 THEN 'canceled' WHEN 2 THEN 'pending' WHEN 3 THEN ' open' WHEN 4 THEN 'strange' ELSE 'filled' END AS raw FROM (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events))")
def venue_statuses(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    raw = F.element_at(F.array(*map(F.lit, ("Closed", "canceled", "pending", " open", "strange", "filled"))), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), S.venue_status(raw).alias("status"))


@query("WITH c AS (SELECT l_suppkey AS pair, l_shipdate AS ts, count(*) AS m FROM lineitem GROUP BY ALL), t AS (SELECT pair, ts, sum(m) OVER (PARTITION BY pair ORDER BY ts)::BIGINT AS n FROM c) SELECT pair, ts, n, n - coalesce(lag(n) OVER (PARTITION BY pair ORDER BY ts), 0) AS new FROM t")
def new_trades(spark, sf_dir):
    """Trades by pair and day, from running totals."""
    days = views.fills(spark, sf_dir).groupBy("pair", "ts").agg(F.count("*").alias("m"))
    totals = days.select("pair", "ts", F.sum("m").over(Window.partitionBy("pair").orderBy("ts")).alias("n"))
    return reports.new_trades(totals, ["pair"], ["ts"])


@query(f"WITH {Q.OP_EVENTS}, s AS (SELECT source, ts::DATE AS day, count(CASE WHEN NOT allowed THEN 1 END) AS blocked, coalesce(string_agg(DISTINCT CASE WHEN NOT allowed THEN reason END, ',' ORDER BY CASE WHEN NOT allowed THEN reason END), '') AS reasons FROM dec WHERE event_type = 'entry_decision' GROUP BY ALL) SELECT *, blocked > 0 AS active FROM s")
def risk_stop_alerts(spark, sf_dir):
    """The risk-stop alert's state by source and day."""
    return reports.risk_stops(views.op_events(spark, sf_dir).withColumn("day", F.to_date("ts")), ["source"], "day")


@query(f"WITH {_BALANCES}, {_ORDERS}, n AS (SELECT (SELECT count(*) FROM ord WHERE NOT matched) + (SELECT count(*) FROM bal WHERE NOT matched) AS mismatches) SELECT mismatches > 0 AS active, mismatches, 'reconciliation mismatch detected (status=' || CASE WHEN mismatches > 0 THEN 'mismatched' ELSE 'matched' END || ', mismatches=' || mismatches || ')' AS message FROM n")
def reconciliation_alert(spark, sf_dir):
    return reports.reconciliation_alert(reconcile.account_summary(reconcile.reconcile_balances(*_balances(spark, sf_dir)), reconcile.reconcile_orders(*_orders(spark, sf_dir))))


# --- folds

_NO_RISK = folds.BacktestConfig(risk=None)
_COSTED = folds.BacktestConfig(risk=None, costs=costs.CostModel(taker_fee=0.2))


def _signalled(spark, sf_dir) -> DataFrame:
    return _px_bars(spark, sf_dir).withColumn("signal", indicators.moving_average_crossover(Series()))


_BT_SOURCE = f"WITH RECURSIVE {Q.TICKS}, {Q.PX_TICKS}, {Q.bars('bars', 'px_ticks')}, one AS (SELECT exchange || '|' || symbol AS series, (row_number() OVER ({Q.SERIES})) - 1 AS i, count(*) OVER (PARTITION BY exchange, symbol) AS n, ts, close, {Q.crossover()} AS signal FROM bars), b AS (SELECT one.*, v.* FROM one, (VALUES ('free', 0.0::DOUBLE, 0.0::DOUBLE), ('costs', 0.002::DOUBLE, 10.0::DOUBLE)) v(variant, fee, fx)), {Q.backtest('b')}"


@query(f"{_BT_SOURCE} SELECT series, variant, ts, side, {_rounded('entry_price', 'exit_price', 'return_pct', 'equity', 'cost')} FROM st WHERE side IS NOT NULL")
def backtest_trades(spark, sf_dir):
    run = folds.backtests(_signalled(spark, sf_dir), {"free": _NO_RISK, "costs": _COSTED}, PAIR)
    return run.where("kind = 'trade'").select("series", "variant", "ts", "side", "entry_price", "exit_price", "return_pct", "equity", "cost")


@query(f"{_BT_SOURCE} SELECT series, ts, i AS seq, round(equity, 6) AS equity FROM st WHERE variant = 'free'")
def backtest_equity(spark, sf_dir):
    return folds.backtests(_signalled(spark, sf_dir), {"free": _NO_RISK}, PAIR).where("kind = 'equity'").select("series", "ts", "seq", "equity")


@query(f"{_BT_SOURCE}, f AS (SELECT series, variant, arg_max(equity, i) AS final, count(side) AS trades, (max(equity) - min(equity)) / max(equity) AS dd FROM st GROUP BY ALL) SELECT a.series, round(a.final, 6) AS baseline_equity, round(c.final, 6) AS costs_equity, round(c.final - a.final, 6) AS equity_delta, a.trades, round(a.dd, 6) AS baseline_drawdown, round(c.dd, 6) AS costs_drawdown FROM f a JOIN f c ON a.series = c.series AND a.variant = 'free' AND c.variant = 'costs'")
def backtest_compare_costs(spark, sf_dir):
    run = folds.backtests(_signalled(spark, sf_dir), {"free": _NO_RISK, "costs": _COSTED}, PAIR)
    of = lambda c, v: F.max(F.when(F.col("variant") == v, F.col(c)))
    # one fold over both variants, its metrics pivoted
    each = run.groupBy("series", "variant").agg(F.max_by("equity", F.when(F.col("kind") == "equity", F.col("seq"))).alias("final"), F.count(F.when(F.col("kind") == "trade", 1)).alias("trades"), analytics.range_drawdown(F.when(F.col("kind") == "equity", F.col("equity"))).alias("dd"))
    return each.groupBy("series").agg(of("final", "free").alias("baseline_equity"), of("final", "costs").alias("costs_equity"), (of("final", "costs") - of("final", "free")).alias("equity_delta"), of("trades", "free").alias("trades"), of("dd", "free").alias("baseline_drawdown"), of("dd", "costs").alias("costs_drawdown"))


_GATED_SQL = f"""WITH RECURSIVE {Q.TICKS}, {Q.PX_TICKS}, {Q.bars('bars', 'px_ticks')}, {Q.RISK_INPUTS},
one AS (SELECT exchange || '|' || symbol AS series, (row_number() OVER ({Q.SERIES})) - 1 AS i, count(*) OVER (PARTITION BY exchange, symbol) AS n, ts, close, {Q.crossover()} AS signal, slippage_pct, spread_pct, volatility_pct, kelly FROM risk),
b AS MATERIALIZED (SELECT one.*, v.* FROM one, (VALUES ('gated', 0.0::DOUBLE, 0.0::DOUBLE), ('costs', 0.002::DOUBLE, 10.0::DOUBLE)) v(variant, fee, fx)), {Q.gated_backtest('b')},
e AS (SELECT series, variant, i, equity, return_pct, CASE WHEN lag(equity) OVER w > 0 THEN equity / lag(equity) OVER w - 1.0 END AS ret FROM st WINDOW w AS (PARTITION BY series, variant ORDER BY i)),
m AS (SELECT series, variant, arg_max(equity, i) AS final_equity, CASE WHEN max(equity) > 0 THEN (max(equity) - min(equity)) / max(equity) ELSE 0.0 END AS max_drawdown, avg(ret) AS mu, stddev_pop(ret) AS sd, stddev_pop(CASE WHEN ret < 0 THEN ret END) AS dn, count(ret) AS nr,
  count(return_pct) AS trades, count(CASE WHEN return_pct > 0 THEN 1 END) AS wins, sum(CASE WHEN return_pct > 0 THEN return_pct END) AS gains, sum(CASE WHEN return_pct < 0 THEN -return_pct END) AS losses,
  coalesce(avg(CASE WHEN return_pct > 0 THEN return_pct END), 0.0) AS avg_win, coalesce(avg(CASE WHEN return_pct < 0 THEN -return_pct END), 0.0) AS avg_loss, coalesce(avg(return_pct), 0.0) AS avg_trade_return FROM e GROUP BY ALL),
x AS (SELECT *, CASE WHEN trades > 0 THEN wins / trades ELSE 0.0 END AS win_rate, round(final_equity / 100.0 - 1.0, 10) AS total_return FROM m)
SELECT series, variant, {_rounded('final_equity', 'max_drawdown', 'win_rate', 'avg_win', 'avg_loss', 'avg_trade_return', 'total_return', places=4)}, trades, round(coalesce(CASE WHEN sd > 0 THEN mu / sd * sqrt(nr) END, 0.0), 4) AS sharpe_ratio,
  round(coalesce(CASE WHEN dn > 0 THEN mu / dn * sqrt(nr) END, 0.0), 4) AS sortino_ratio, round(coalesce(gains / nullif(losses, 0), 0.0), 4) AS profit_factor, round(CASE WHEN trades > 0 THEN win_rate * avg_win - (1.0 - win_rate) * avg_loss ELSE 0.0 END, 4) AS expectancy,
  round(CASE WHEN max_drawdown > 0 THEN total_return / max_drawdown ELSE 0.0 END, 4) AS calmar_ratio FROM x"""


@query(_GATED_SQL, places=4)
def backtest_with_risk(spark, sf_dir):
    """All metrics of gated runs: drawdown stops feed back into entries."""
    rows = indicators.with_risk_inputs(_px_bars(spark, sf_dir)).withColumn("signal", indicators.moving_average_crossover(Series()))
    return analytics.run_metrics(folds.backtests(rows, {"gated": folds.BacktestConfig(), "costs": folds.BacktestConfig(costs=costs.CostModel.of("firi"))}, PAIR), 100.0)


def _walk(spark, sf_dir) -> DataFrame:
    parts = walkforward.assign_folds(_px_bars(spark, sf_dir), PAIR, 40, 20, 20)
    rows = parts.withColumn("signal", indicators.moving_average_crossover(Series((*PAIR, "start_index"), ("place",))))
    return walkforward.walk_forward(rows, PAIR, _NO_RISK)


_WALK_SQL = f"""WITH RECURSIVE {Q.TICKS}, {Q.PX_TICKS}, {Q.bars('bars', 'px_ticks')},
x AS (SELECT exchange || '|' || symbol AS s, row_number() OVER ({Q.SERIES}) - 1 AS bi, count(*) OVER (PARTITION BY exchange, symbol) AS nb, ts, close FROM bars),
y AS (SELECT s, start, bi - start AS i, ts, close FROM (SELECT *, unnest(range(0, greatest(0, nb - 59), 20)) AS start FROM x) WHERE bi >= start AND bi < start + 60),
b AS (SELECT s || '|' || start AS series, s, start, 'walk' AS variant, 0.0::DOUBLE AS fee, 0.0::DOUBLE AS fx, i, 60 AS n, ts, close, {Q.crossover('PARTITION BY s, start ORDER BY i')} AS signal FROM y), {Q.backtest('b')},
folds AS (SELECT regexp_replace(series, '\\|[0-9]+$', '') AS series, regexp_extract(series, '[0-9]+$')::INT AS start_index, max(CASE WHEN i = 39 THEN equity END) AS initial_equity, arg_max(equity, i) AS final_equity, count(CASE WHEN i >= 40 THEN side END) AS trades, count(CASE WHEN i >= 40 AND return_pct > 0 THEN 1 END) AS wins FROM st GROUP BY ALL),
res AS (SELECT series, start_index, initial_equity, final_equity, final_equity / initial_equity - 1.0 AS return_pct, trades, CASE WHEN trades > 0 THEN wins / trades ELSE 0 END::DOUBLE AS win_rate FROM folds)"""


@query(f"{_WALK_SQL} SELECT series, start_index, {_rounded('initial_equity', 'final_equity', 'return_pct')}, trades, round(win_rate, 6) AS win_rate FROM res")
def walk_forward_folds(spark, sf_dir):
    return _walk(spark, sf_dir)


@query(f"{_WALK_SQL} SELECT series, count(*) AS fold_count, round(avg(return_pct), 4) AS avg_return, round(median(return_pct), 4) AS median_return, count(CASE WHEN return_pct > 0 THEN 1 END) AS positive_folds, round(pow(1 + avg(return_pct), count(*)) - 1, 4) AS cumulative_return FROM res GROUP BY series", places=4)
def walk_forward_summary(spark, sf_dir):
    return walkforward.summary(_walk(spark, sf_dir))


@query()
def paper_trades(spark, sf_dir):
    rows = indicators.with_risk_inputs(_px_bars(spark, sf_dir)).withColumn("signal", indicators.moving_average_crossover(Series()))
    variants = {"plain": folds.PaperConfig(initial_cash=1000.0), "partial": folds.PaperConfig(initial_cash=1000.0, partial_fill_fraction=0.5, max_order_lifetime_bars=4), "sandbox": folds.PaperConfig(initial_cash=1000.0, execution="sandbox")}
    return folds.paper_runs(rows, variants, PAIR).where("kind = 'trade'").select("series", "variant", "ts", "order_id", "side", "price", "size", "cost")


@query()
def l2_sim_trades(spark, sf_dir):
    variants = {"plain": folds.SimulatorConfig(), "now": folds.SimulatorConfig(latency_ms=0, position_size=4.0), "harsh": folds.SimulatorConfig(queue_penalty=0.0001, impact_penalty=0.0002, adverse_penalty=0.5)}
    run = folds.simulations(_signalled_books(spark, sf_dir), variants, ["symbol"])
    return run.where("kind = 'trade'").select("series", "variant", "ts", "side", "price", "size", "cost")
