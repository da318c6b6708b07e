"""Pieces of the DuckDB SQL that queries are held against: the views, and what several queries share."""

from __future__ import annotations

TICKS = """ticks AS (
  SELECT event_id AS id, event_type AS exchange, ['BTC/NOK','ETH/NOK','SOL/NOK','XRP/NOK'][(user_id % 4 + 1)::INT] AS symbol, ts,
         round(value * 0.999, 6) AS bid, round(value * 1.001, 6) AS ask, value AS last, json_extract_string(props, '$.k')::DOUBLE AS volume
  FROM events)"""

PX_TICKS = """px_ticks AS (
  SELECT id, exchange, symbol, ts, round(100 + last / 100, 6) AS bid, round(100 + last / 100, 6) AS ask, round(100 + last / 100, 6) AS last, volume FROM ticks)"""


def bucket(width: str, ts: str = "ts") -> str:
    return f"make_timestamp((epoch_us({ts}) // ({width} * 1000000::BIGINT)) * ({width} * 1000000::BIGINT))"


def bars(name: str, source: str, width: str = "3600", stream: bool = False, widths: str = "") -> str:
    """A CTE of bars; ``widths``: a FROM item with a column w for several intervals."""
    if stream:
        o, h, low, v = "coalesce(last, bid)", "greatest(coalesce(last, bid), ask)", "least(coalesce(last, bid), bid)", "coalesce(volume, 0)"
    else:
        o, h, low, v = "coalesce(nullif(last, 0), nullif(bid, 0), 0)", "coalesce(nullif(last, 0), nullif(ask, 0), 0)", "coalesce(nullif(bid, 0), nullif(last, 0), 0)", "coalesce(volume, 0)"
    w = "w" if widths else width
    return f"""{name} AS (
  SELECT exchange, symbol, {w}::INT AS interval_seconds, {bucket(w)} AS ts, arg_min({o}, ts) AS open, max({h}) AS high, min({low}) AS low, arg_max({o}, ts) AS close, sum({v}) AS volume
  FROM {source}{f', {widths}' if widths else ''} GROUP BY ALL)"""


HOURLY = f"WITH {TICKS}, {bars('bars', 'ticks')}"
PX_HOURLY = f"WITH {TICKS}, {PX_TICKS}, {bars('bars', 'px_ticks')}"
SERIES = "PARTITION BY exchange, symbol ORDER BY ts"
SIGN = "CASE WHEN {0} > 0 THEN 1.0::DOUBLE WHEN {0} < 0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END"


def frame(rows: int, series: str = SERIES) -> str:
    return f"OVER ({series} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def crossover(series: str = SERIES, short: int = 3, long: int = 6) -> str:
    diff = f"(round(avg(close) {frame(short, series)}, 10) - round(avg(close) {frame(long, series)}, 10))"
    return f"CASE WHEN row_number() OVER ({series}) < {long} THEN 0.0::DOUBLE ELSE {SIGN.format(diff)} END"


def move(lookback: int, threshold: float) -> str:
    before = f"lag(close, {lookback}) OVER ({SERIES})"
    change = f"round((close - {before}) / nullif({before}, 0), 10)"
    return f"CASE WHEN {before} > 0 AND {change} > {threshold} THEN 1.0::DOUBLE WHEN {before} > 0 AND {change} < -{threshold} THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END"


#: CTEs r (returns) and risk (what the gate takes from bars), over a CTE bars.
RISK_INPUTS = f"""r AS (
  SELECT *, CASE WHEN lag(close) OVER ({SERIES}) > 0 THEN (close - lag(close) OVER ({SERIES})) / lag(close) OVER ({SERIES}) END AS ret, lag(ts) OVER ({SERIES}) AS ts0, row_number() OVER ({SERIES}) AS rn FROM bars),
k AS (
  SELECT *, coalesce(stddev_pop(ret) {frame(9)}, 0) AS vol, count(ret) {frame(19)} AS n, count(CASE WHEN ret > 0 THEN 1 END) {frame(19)} AS wins, count(CASE WHEN ret < 0 THEN 1 END) {frame(19)} AS losses,
         avg(CASE WHEN ret > 0 THEN ret END) {frame(19)} AS gain, avg(CASE WHEN ret < 0 THEN -ret END) {frame(19)} AS loss FROM r),
risk AS (
  SELECT *, round(vol, 8) AS volatility_pct,
    round(CASE WHEN rn = 1 THEN 1.0 WHEN n < 2 THEN CASE WHEN wins > 0 THEN 1.0 ELSE 0.0 END WHEN losses = 0 THEN CASE WHEN wins > 0 THEN 0.25 ELSE 0.125 END WHEN wins = 0 THEN 0.125
      ELSE greatest(0.0, least(1.0, greatest(0.0, least(1.0, (wins / n * (gain / loss) - (1.0 - wins / n)) / (gain / loss))) * 0.5)) END::DOUBLE, 8) AS kelly,
    round(CASE WHEN close > 0 THEN abs(close - open) / close ELSE 0 END, 8) AS slippage_pct, round(CASE WHEN close > 0 THEN abs(high - low) / close ELSE 0 END, 8) AS spread_pct,
    coalesce(epoch_us(ts) - epoch_us(ts0) > 900000000, false) AS stale FROM k)"""

FILLS = """fills AS (
  SELECT l_suppkey AS pair, l_shipdate AS ts, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, l_extendedprice / l_quantity AS price, l_quantity AS size, l_extendedprice * l_tax AS fee,
         l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem)"""
_FILL_ORDER = "ts, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag"
#: CTEs down to trips (closed) and numbered (all buys and valid sells).
TRIPS = f"""{FILLS},
f0 AS MATERIALIZED (SELECT pair, ts, side, price, size, fee, row_number() OVER (PARTITION BY pair ORDER BY {_FILL_ORDER}) AS i, CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS step FROM fills),
f1 AS (SELECT *, sum(step) OVER (PARTITION BY pair ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM f0),
f2 AS (SELECT *, s - step - least(0, coalesce(min(s) OVER (PARTITION BY pair ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS queue FROM f1),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair, side ORDER BY i) AS k FROM f2 WHERE side = 'buy' OR queue > 0),
trips AS MATERIALIZED (
  SELECT s.pair, s.k, b.ts AS entry_time, b.price AS entry_price, s.ts AS exit_time, s.price AS exit_price, s.size, b.fee + s.fee AS total_fees, (s.price - b.price) * s.size AS gross_pnl, (s.price - b.price) * s.size - (b.fee + s.fee) AS net_pnl
  FROM (SELECT * FROM numbered WHERE side = 'sell') s JOIN (SELECT * FROM numbered WHERE side = 'buy') b ON s.pair = b.pair AND s.k = b.k)"""

EQUITY = "equity AS (SELECT o_orderkey AS id, o_orderdate AS ts, o_orderpriority AS source, o_totalprice AS equity FROM orders)"

OP_EVENTS = """op AS (
  SELECT event_id AS id, ts, event_type AS source, json_extract_string(props, '$.k')::BIGINT AS k,
         CASE WHEN event_type = 'error' THEN 'runtime_alert' WHEN json_extract_string(props, '$.k')::BIGINT % 3 = 0 THEN 'order_lifecycle' ELSE 'entry_decision' END AS event_type FROM events),
dec AS (SELECT id, ts, source, event_type, k % 2 = 0 AS allowed, 'reason_' || (k % 7) AS reason, CASE WHEN k % 2 = 0 THEN 'FILLED' ELSE 'CANCELED' END AS status FROM op WHERE event_type <> 'runtime_alert')"""

BOOKS = """books AS (
  SELECT vec_id AS id, ['BTC/NOK','ETH/NOK','SOL/NOK','XRP/NOK'][(vec_id % 4 + 1)::INT] AS symbol, make_timestamp((1704067200 + vec_id * 60) * 1000000) AS ts,
    list_transform(range(0, 8), lambda i: {'price': round(round(100 - 0.05 * (i + 1), 4) + label % 5 * 0.01, 4)::DOUBLE, 'size': round(abs(embedding[i + 1]::DOUBLE) * 10, 4)}) AS bids,
    list_transform(range(0, 8), lambda i: {'price': round(round(100 + 0.05 * (i + 1), 4) + label % 5 * 0.01, 4)::DOUBLE, 'size': round(abs(embedding[i + 9]::DOUBLE) * 10, 4)}) AS asks
  FROM embeddings),
depth AS (
  SELECT *, (bids[1].price + asks[1].price) / 2 AS mid, list_sum(list_transform(bids[1:5], lambda x: x.size)) AS b, list_sum(list_transform(asks[1:5], lambda x: x.size)) AS a,
    list_sum(list_transform(bids[1:5], lambda x: x.price * x.size)) + list_sum(list_transform(asks[1:5], lambda x: x.price * x.size)) AS worth FROM books)"""


def price(base: str, sign: str, fee: str, fx: str) -> str:
    return f"(({base} + {sign} * {base} * {fee}) * (1 + {sign} * {fx} / 10000.0))"


def backtest(source: str) -> str:
    """A recursive CTE st over ``source`` (series, variant, fee, fx, i, n, ts, close, signal): a row a bar, with its trade."""
    leave = "(s.pos <> 0 AND (b.i = b.n - 1 OR b.signal * s.pos <= 0))"
    enter = "(s.pos = 0 AND b.signal <> 0)"
    out = price("b.close", "-s.pos", "b.fee", "b.fx")
    ret = f"(s.pos * ({out} - s.entry) / s.entry)"
    return f"""st AS (
  SELECT series, variant, 0::BIGINT AS i, ts, 0::DOUBLE AS pos, 0::DOUBLE AS entry, 100::DOUBLE AS equity, NULL::VARCHAR AS side, NULL::DOUBLE AS entry_price, NULL::DOUBLE AS exit_price, NULL::DOUBLE AS return_pct, NULL::DOUBLE AS cost FROM {source} WHERE i = 0 AND n >= 2
  UNION ALL
  SELECT b.series, b.variant, b.i, b.ts, CASE WHEN {leave} THEN 0 WHEN {enter} THEN sign(b.signal) ELSE s.pos END::DOUBLE, CASE WHEN {enter} THEN {price('b.close', 'sign(b.signal)', 'b.fee', 'b.fx')} ELSE s.entry END,
    CASE WHEN {leave} THEN s.equity * (1 + {ret}) ELSE s.equity END, CASE WHEN {leave} THEN CASE WHEN s.pos > 0 THEN 'long' ELSE 'short' END END, CASE WHEN {leave} THEN s.entry END, CASE WHEN {leave} THEN {out} END, CASE WHEN {leave} THEN {ret} END,
    CASE WHEN {leave} THEN abs({out} - b.close) + abs(s.entry - b.close) END
  FROM st s JOIN {source} b ON b.series = s.series AND b.variant = s.variant AND b.i = s.i + 1)"""


def gated_backtest(source: str) -> str:
    """As ``backtest``, with the gate: ``source`` also has slippage_pct, spread_pct, volatility_pct and kelly."""
    down = "(CASE WHEN s.peak > 0 THEN greatest(0.0, (s.peak - s.equity) / s.peak) ELSE 0.0 END)"
    blocked = f"(b.slippage_pct > 0.03 OR b.spread_pct > 0.03 OR {down} > 0.02 OR b.volatility_pct > 0.1)"
    base = "(CASE WHEN b.volatility_pct <= 0 THEN 1.0 ELSE least(1.0, 0.02::DOUBLE / b.volatility_pct) * b.kelly END)"
    sized = f"greatest(0.0, least(1.0, {base}, 5000.0 / greatest(1.0, s.equity)))"
    leave = "(s.pos <> 0 AND (b.i = b.n - 1 OR b.signal * s.pos <= 0))"
    enter = f"(s.pos = 0 AND b.signal <> 0 AND NOT {blocked})"
    out = price("b.close", "-s.pos", "b.fee", "b.fx")
    ret = f"(s.pos * ({out} - s.entry) / s.entry)"
    equity = f"(CASE WHEN {leave} THEN s.equity * (1 + s.size * {ret}) ELSE s.equity END)"
    return f"""st AS (
  SELECT series, variant, 0::BIGINT AS i, ts, 0::DOUBLE AS pos, 0::DOUBLE AS entry, 1::DOUBLE AS size, 100::DOUBLE AS equity, 100::DOUBLE AS peak, NULL::DOUBLE AS return_pct FROM {source} WHERE i = 0 AND n >= 2
  UNION ALL
  SELECT b.series, b.variant, b.i, b.ts, CASE WHEN {leave} THEN 0 WHEN {enter} THEN sign(b.signal) ELSE s.pos END::DOUBLE, CASE WHEN {enter} THEN {price('b.close', 'sign(b.signal)', 'b.fee', 'b.fx')} ELSE s.entry END,
    CASE WHEN {enter} THEN {sized} ELSE s.size END::DOUBLE, {equity}, greatest(s.peak, {equity}), CASE WHEN {leave} THEN {ret} END
  FROM st s JOIN {source} b ON b.series = s.series AND b.variant = s.variant AND b.i = s.i + 1)"""
