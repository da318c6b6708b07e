"""Operators on hand-made rows with known results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ticksmith.functions import orderbook
from ticksmith.functions import scalars as S
from ticksmith.functions.costs import CostModel
from ticksmith.operators import bars, folds, indicators, reconcile, reports, risk, trades, walkforward
from ticksmith.operators.indicators import Series
from ticksmith.sources import feeds, market, sinks
from ticksmith.streaming import bars as stream

T0 = dt.datetime(2024, 1, 1)


def ts(k, step=60):
    return T0 + dt.timedelta(seconds=k * step)


def tick_rows(spark, rows):
    return spark.createDataFrame([(i, "firi", "BTC/NOK", *r) for i, r in enumerate(rows)], "id long, exchange string, symbol string, ts timestamp, bid double, ask double, last double, volume double")


def series(spark, closes, signals=None, **more):
    rows = spark.createDataFrame([("e", "s", ts(k), float(c), float(c), float(c), float(c), 1.0, float((signals or [0] * len(closes))[k])) for k, c in enumerate(closes)], "exchange string, symbol string, ts timestamp, open double, high double, low double, close double, volume double, signal double")
    return indicators.with_risk_inputs(rows, **more)


def test_batch_bars(spark):
    t = tick_rows(spark, [(ts(1, 1), 99.5, 100.5, 100.0, 1.0), (ts(2, 1), 100.5, 101.5, 101.0, 1.0), (ts(3, 1), 99.0, 100.0, 99.5, 1.0)])
    r = bars.build_bars(t, 60).first()
    assert (r.open, r.high, r.low, r.close, r.volume) == (100.0, 101.0, 99.0, 99.5, 3.0)
    assert {x.interval_seconds for x in bars.build_all_intervals(t).collect()} == set(bars.INTERVALS)
    with pytest.raises(ValueError):
        bars.build_bars(t, 3)


def test_ties_zero_and_null_quotes(spark):
    t = tick_rows(spark, [(ts(0), 10.0, 12.0, 0.0, None), (ts(0), 9.0, 13.0, None, 2.0), (ts(0), 8.0, 14.0, 11.0, 1.0)])
    r = bars.build_bars(t, 60).first()
    assert (r.open, r.close, r.high, r.low, r.volume) == (11.0, 10.0, 13.0, 8.0, 3.0)
    r = bars.build_stream_bars(t, 60).first()
    assert (r.open, r.close, r.high, r.low) == (11.0, 0.0, 14.0, 0.0)


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    t = tick_rows(spark, [(ts(0), 100.0, 101.0, 100.5, 1.0), (ts(1, 30), 99.0, 102.0, 101.0, 2.0), (ts(2), 5.0, 6.0, None, None)])
    t.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in")
    q = stream.stream_bars(source, 60).writeStream.outputMode("update").format("memory").queryName("streamed").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("streamed")
    want = bars.build_stream_bars(t, 60).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    r = got.where(F.col("ts") == F.lit(T0)).first()
    assert (r.open, r.high, r.low, r.close, r.volume) == (100.5, 102.0, 99.0, 101.0, 3.0)


def test_streamed_alerts_are_raised_once(spark, tmp_path):
    for n, rows in enumerate([[("a", 1, True), ("a", 2, True), ("b", 3, False)], [("a", 4, True), ("a", 5, False), ("b", 6, True)]]):
        spark.createDataFrame(rows, "key string, id long, active boolean").coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")
    source = spark.readStream.schema("key string, id long, active boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stream.alert_edges(source).writeStream.outputMode("append").format("memory").queryName("edges").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("edges").collect())) == [("a", 1, "raised"), ("a", 5, "cleared"), ("b", 6, "raised")]


def test_restarts_and_backoff():
    waits, tries = [], []

    class Query:
        def awaitTermination(self):  # noqa: N802
            tries.append(1)
            if len(tries) < 3:
                raise RuntimeError

    assert stream.run_with_restarts(Query, 3, stream.Backoff(1, 2, 1.5, 0), waits.append) == 2 and waits == [1.0, 1.5]
    tries[:] = [1] * -5
    with pytest.raises(RuntimeError):
        stream.run_with_restarts(Query, 1, sleep=lambda s: None)


def test_order_book(spark):
    levels = "array<struct<price: double, size: double>>"
    b = spark.createDataFrame([([(100.0, 2.0), (99.9, 1.0), (99.8, 0.5)], [(100.2, 1.5), (100.3, 0.8), (100.4, 0.2)])], f"bids {levels}, asks {levels}")
    r = orderbook.with_metrics(b, 3).first()
    assert (r.mid_price, r.spread, r.bid_volume, r.ask_volume) == (100.1, 0.2, 3.5, 2.5)
    assert r.imbalance == pytest.approx(1 / 6) and r.micro_price == pytest.approx(100.1166666667)
    fill = b.select(orderbook.depth_fill(F.col("bids"), F.col("asks"), "buy", F.lit(2.0), F.lit(0.0)).alias("f")).first().f
    assert fill.filled == 2.0 and fill.price == pytest.approx((1.5 * 100.2 + 0.5 * 100.3) / 2)
    with pytest.raises(Exception, match="needs bids and asks"):
        orderbook.with_metrics(b.withColumn("bids", F.slice("bids", 1, 0))).collect()


def test_trend_filter(spark):
    rows = [(ts(0), 100.0, 101.0, 99.0, 100.5), (ts(1), 100.5, 103.0, 100.0, 102.5), (ts(2), 102.5, 105.0, 101.0, 104.0)]
    b = spark.createDataFrame([("e", "s", *r) for r in rows], "exchange string, symbol string, ts timestamp, open double, high double, low double, close double")
    r = indicators.with_trend_filter(b, lookback=3, multiplier=1.0).orderBy("ts").collect()[-1]
    assert (r.momentum, r.volatility, r.direction) == (1.5, 3.5, "neutral") and r.value == pytest.approx(0.4285714286)


def run(spark, closes, signals, config):
    out = folds.backtests(series(spark, closes, signals), {"v": config}, ["symbol"]).collect()
    return [r for r in out if r.kind == "trade"], [r.equity for r in sorted((r for r in out if r.kind == "equity"), key=lambda r: r.seq)]


def test_backtests(spark):
    t, e = run(spark, [100, 101, 102], [0, 0, 0], folds.BacktestConfig())
    assert not t and e == [100.0] * 3
    t, e = run(spark, [100, 105, 106], [0, 1, 1], folds.BacktestConfig(risk=None))
    assert len(t) == 1 and e[-1] == pytest.approx(100.9523809524)
    t, e = run(spark, [100, 100, 101], [0, 1, -1], folds.BacktestConfig(risk=None, costs=CostModel(taker_fee=0.5, fx_spread_bps=100)))
    assert (t[0].entry_price, t[0].exit_price) == (pytest.approx(101.505), pytest.approx(99.49005)) and e[-1] == pytest.approx(98.0149254)
    open_ = dict(max_volatility_pct=9.0, max_slippage_pct=9.0, max_spread_pct=9.0, risk_per_trade_pct=9.0)
    t, e = run(spark, [100, 90, 80, 85], [0, 1, -1, 1], folds.BacktestConfig(risk=risk.RiskConfig(max_drawdown_pct=0.15, **open_)))
    assert len(t) == 1 and e[-1] < 100


def test_paper_engine(spark):
    def go(closes, signals, **c):
        out = folds.paper_runs(series(spark, closes, signals), {"v": folds.PaperConfig(**c)}, ["symbol"]).collect()
        pick = lambda k: [r for r in out if r.kind == k]
        return pick("order"), pick("trade"), pick("equity")

    o, t, _ = go([100, 101, 102], [1, 0, 0], initial_cash=1000.0, max_order_lifetime_bars=5)
    assert [x.status for x in o] == ["FILLED"] and t[0].price == pytest.approx(102.102)
    o, t, e = go([100, 101, 102, 103, 104], [1, 0, -1, 0, 0], initial_cash=1000.0, max_order_lifetime_bars=5)
    assert [x.side for x in t] == ["buy", "sell"] and max(e, key=lambda r: r.seq).cash == pytest.approx(1001.794)
    o, t, _ = go([100, 101, 102], [1, 0, 0], initial_cash=1000.0, max_order_lifetime_bars=1)
    assert o[0].status == "CANCELED" and not t
    o, _, _ = go([50_000] * 3, [1, 0, 0], initial_cash=1000.0)
    assert o[0].size == pytest.approx(0.02)
    o, t, _ = go([100, 101], [-1, 0], initial_cash=1000.0, execution="sandbox")
    assert o[0].status == "CANCELED" and o[0].reason == "insufficient_cash_or_position"


def test_depth_simulator(spark):
    levels = "array<struct<price: double, size: double>>"

    def go(books, signals, **c):
        rows = spark.createDataFrame([("s", ts(k), *b, float(x)) for k, (b, x) in enumerate(zip(books, signals, strict=True))], f"symbol string, ts timestamp, bids {levels}, asks {levels}, signal double")
        out = folds.simulations(rows, {"v": folds.SimulatorConfig(**c)}, ["symbol"]).collect()
        return [r for r in out if r.kind == "trade"], [r.equity for r in sorted((r for r in out if r.kind == "equity"), key=lambda r: r.seq)]

    book = ([(100.0, 1.0)], [(101.0, 1.0)])
    t, e = go([book, book], [1, 0], costs=CostModel(taker_fee=0.5, fx_spread_bps=100), max_slippage=0.0)
    assert t[0].side == "buy" and t[0].price == pytest.approx(102.52005) and e[0] == 100.0
    t, _ = go([([(100.0, 5.0)], [(101.0, 1.0), (102.0, 1.0)])], [1], position_size=2.0, latency_ms=0)
    assert (t[0].size, t[0].price) == (2.0, pytest.approx(101.6015))


GATE = dict(slippage=0.0, spread=0.0, stale=False, volatility=0.05, kelly=0.5, equity=100.0, peak=100.0)


@pytest.mark.parametrize(
    "reason,given,config,exchange",
    [
        ("drawdown_limit", {"equity": 80.0}, {"max_drawdown_pct": 0.15}, None), ("hard_stop_drawdown", {"equity": 98.0}, {"hard_stop_drawdown_pct": 0.01}, None), ("spread_limit", {"spread": 0.2}, {}, None), ("slippage_limit", {"slippage": 0.5}, {}, None),
        ("stale_quote", {"stale": True}, {"enforce_quote_freshness": True}, None), ("open_order_limit", {"open_orders": 2}, {}, "kraken"), ("exchange_notional_limit", {"notional": 2000.0}, {}, "firi"), ("hard_stop", {"hard_stop": True}, {}, None),
        ("position_open", {"position": 1.0}, {}, None), ("position_limit", {"open_positions": 3}, {}, None), ("exchange_position_limit", {"open_positions": 1}, {}, "firi"), ("volatility_limit", {"volatility": 0.5}, {}, None), (None, {}, {}, "kraken"),
        (None, {"skew": 0.8, "side": "buy"}, {}, None), (None, {"volatility": 0.0, "notional": 600.0}, {}, "kraken"),
    ],
)
def test_gate_and_its_twin(spark, reason, given, config, exchange):
    cfg, x = risk.RiskConfig(**config), GATE | given
    allowed, size, why = risk.Gate(cfg, exchange).evaluate(**x)
    assert why == reason and allowed == (reason is None)
    row = {"exchange": exchange, "slippage_pct": x["slippage"], "spread_pct": x["spread"], "stale": x["stale"], "volatility_pct": x["volatility"], "kelly": x["kelly"], "equity": x["equity"], "peak_equity": x["peak"], "position": x.get("position", 0.0), "open_positions": x.get("open_positions", 0), "venue_open_positions": x.get("open_positions", 0), "open_orders": x.get("open_orders", 0), "venue_notional": x.get("notional", 0.0), "inventory_skew": x.get("skew", 0.0), "signal_side": x.get("side"), "hard_stop": x.get("hard_stop", False), "breaker": False}
    ddl = ", ".join(f"{k} {'string' if k in ('exchange', 'signal_side') else 'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double'}" for k, v in row.items())
    r = risk.decide(spark.createDataFrame([tuple(row.values())], ddl), cfg).first()
    assert (r.allowed, r.reason) == (allowed, reason) and r.position_size == pytest.approx(size)


def test_own_rules_come_after_the_limits(spark):
    """Ties in what blocks, null conditions, and sizes beyond the venue's limit, below 0 or null."""
    inputs = "exchange string, slippage_pct double, spread_pct double, stale boolean, volatility_pct double, kelly double, equity double, peak_equity double, position double, open_positions int, venue_open_positions int, open_orders int, venue_notional double, inventory_skew double, signal_side string, hard_stop boolean, breaker boolean, mood int, factor double"
    rows = [("kraken", 0.0, 0.0, False, 0.05, 0.5, 100.0, 100.0, float(blocked), 0, 0, 0, 0.0, 0.0, "buy", False, False, mood, factor) for blocked, mood, factor in [(1, 3, 1.0), (0, 3, 1.0), (0, 2, 1.0), (0, None, 0.5), (0, 0, 9.0), (0, 0, -1.0), (0, 0, None)]]
    rules = [(F.col("mood") > 2, "mood"), (F.col("mood") > 1, "later")]
    out = risk.decide(spark.createDataFrame(rows, inputs), rules=rules, sizing=lambda size: size * F.col("factor"))
    own = risk.decide(spark.createDataFrame(rows[3:4], inputs)).first().position_size
    assert own > 0
    got = [(r.reason, r.allowed, pytest.approx(r.position_size)) for r in out.collect()]
    assert got == [("position_open", False, 0.0), ("mood", False, 0.0), ("later", False, 0.0), (None, True, own / 2), (None, True, 0.5), (None, True, 0.0), (None, True, 0.0)]


def test_round_trips_equal_a_queue(spark):
    rng = random.Random(4)
    rows = [(k % 3, ts(k), k, rng.choice(["buy", "sell"]), rng.uniform(1, 9), rng.uniform(1, 3), 0.1) for k in range(400)]
    want = []
    queues = {}
    for pair, t, _, side, price, size, fee in rows:
        q = queues.setdefault(pair, [])
        if side == "buy":
            q.append((t, price))
        elif q:
            t0, p0 = q.pop(0)
            want.append((pair, t0, t, (price - p0) * size))
    f = spark.createDataFrame(rows, "pair int, ts timestamp, id long, side string, price double, size double, fee double")
    got = trades.round_trips(f, ["pair"], ["ts", "id"]).select("pair", "entry_time", "exit_time", "gross_pnl").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert trades.open_positions(f, ["pair"], ["ts", "id"]).count() == sum(map(len, queues.values()))


def test_walk_forward_folds(spark):
    b = spark.createDataFrame([("e", "s", ts(k), 100 + 0.5 * k) for k in range(20)], "exchange string, symbol string, ts timestamp, close double")
    parts = walkforward.assign_folds(b, ["exchange", "symbol"], 5, 3, 2)
    rows = parts.withColumn("signal", indicators.signal_trend(Series(("exchange", "symbol", "start_index"), ("place",))))
    got = walkforward.walk_forward(rows, ["exchange", "symbol"], folds.BacktestConfig(risk=None), 5, 3, 2)
    assert got.count() == 7 and walkforward.summary(got).first().fold_count == 7


def test_reconciliation(spark):
    a = spark.createDataFrame([("NOK", 1000.0), ("EUR", 100.0)], "key string, amount double")
    b = spark.createDataFrame([("NOK", 950.0), ("BTC", 0.5)], "key string, amount double")
    got = {r.key: (r.matched, r.merged_amount) for r in reconcile.reconcile_balances(a, b).collect()}
    assert got == {"NOK": (False, 950.0), "EUR": (False, 100.0), "BTC": (False, 0.5)}
    ddl = "order_id string, side string, size double, status string, filled_size double, fill_price double, fee double"
    local = spark.createDataFrame([("1", "buy", 0.25, "SUBMITTED", 0.0, None, 0.0)], ddl)
    remote = spark.createDataFrame([("1", "buy", 0.25, "filled", 0.25, 100.0, 0.25), ("2", "sell", 1.0, "open", 0.0, None, 0.0)], ddl)
    got = {r.order_id: r for r in reconcile.recover_orders(local, remote).collect()}
    assert got["1"].status == "FILLED" and got["1"].fee == 0.25 and got["2"].inserted and got["2"].recovered


def test_scalars(spark):
    r = spark.range(1).select(S.bucket_start(F.lit("2024-01-01 12:00:34").cast("timestamp"), 60).alias("b"), S.normalize_symbol(F.lit("btc/nok")).alias("s"), S.venue_pair(F.lit("BTC/EUR")).alias("p"), S.parse_timestamp(F.lit("bad")).alias("t"), S.coerce_float(F.lit("1e2")).alias("f"), S.normalize_side(F.lit(" Long ")).alias("side")).first()
    assert (str(r.b), r.s, r.p, r.t, r.f, r.side) == ("2024-01-01 12:00:00", "BTCNOK", "XXBTZEUR", None, 100.0, "buy")


def test_payloads(spark):
    j = lambda text: spark.createDataFrame([(ts(0), text)], "ts timestamp, json string")
    r = market.firi_ticks(j('[{"id":"BTCNOK","last":"123.45","todays_volume":"1.23"},{"id":"ETHNOK","last":"1"}]'), "BTC/NOK").collect()
    assert [(x.bid, x.ask, x.last, x.volume) for x in r] == [(123.45, 123.45, 123.45, 1.23)]
    r = market.kraken_ticks(j('{"a":["100.50"],"b":["100.00"],"c":["100.25"],"v":["1","4.56"]}'), "BTC/NOK").first()
    assert (r.bid, r.ask, r.last, r.volume) == (100.0, 100.5, 100.25, 4.56)
    r = market.history_bars(j('[[1710000000,100,101,99.5,100.5,100.2,10,1],[1,2]]'), "BTC/NOK", 60).collect()
    assert [(x.close, x.volume) for x in r] == [(100.5, 10.0)]
    walk = market.mock_walk(spark, ["A", "B"], 50).collect()
    assert len(walk) == 100 and all(x.bid < x.last < x.ask for x in walk)


def test_sinks(spark, tmp_path):
    path, ddl = f"{tmp_path}/s", "report_date date, created_at timestamp, total_trades long"
    rows = lambda *r: spark.createDataFrame([(dt.date(2024, 1, d), ts(k), n) for d, k, n in r], ddl)
    sinks.upsert(rows((1, 0, 5), (2, 0, 6)), path, ["report_date"], ["created_at"], ddl)
    sinks.upsert(rows((2, 1, 7), (3, 1, 8)), path, ["report_date"], ["created_at"], ddl)
    got = market.read_table(spark, path, ddl).orderBy("report_date").collect()
    assert [r.total_trades for r in got] == [5, 7, 8]
    assert market.read_ticks(spark, f"{tmp_path}/none").count() == 0
    ticks = tick_rows(spark, [(ts(k), 1.0, 2.0, 1.5, 1.0) for k in range(15)])
    sinks.append(ticks, f"{tmp_path}/t")
    assert [r.id for r in market.latest(spark.read.parquet(f"{tmp_path}/t"), 3).collect()] == [14, 13, 12]


def test_recovered_orders_keep_what_the_venue_leaves_out(spark):
    ddl = "order_id string, side string, size double, status string, filled_size double, fill_price double, fee double"
    local = spark.createDataFrame([("1", "buy", 1.0, "OPEN", 0.5, 10.0, 0.1), ("2", "buy", 1.0, "OPEN", None, None, None)], ddl)
    remote = spark.createDataFrame([("1", "buy", 1.0, "", None, None, None), ("3", "", None, "", None, None, None)], ddl)
    got = {r.order_id: tuple(r)[1:] for r in reconcile.recover_orders(local, remote).collect()}
    assert got == {"1": ("buy", 1.0, "OPEN", 0.5, 10.0, 0.1, True, False), "2": ("buy", 1.0, "OPEN", None, None, None, False, False), "3": ("unknown", 0.0, "SUBMITTED", None, None, 0.0, True, True)}


def test_recovery_applies_fills_and_the_snapshot_wins(spark):
    """A sent buy of 0.25 at 100 comes back filled with a fee of 0.25; then the venue's balances replace local ones."""
    local = spark.createDataFrame([("a", "1", "buy", 0.25, 100.0, "SUBMITTED", None, None, None)], "account string, order_id string, side string, size double, price double, status string, filled_size double, fill_price double, fee double")
    remote = spark.createDataFrame([("1", 1, "FILLED", 0.25, 100.0, 0.25)], "order_id string, seq long, status string, filled_size double, fill_price double, fee double")
    start = spark.createDataFrame([("a", 1000.0, 0.0), ("b", 5.0, 1.0)], "account string, balance double, position double")
    got = {r.account: (r.balance, r.position) for r in reconcile.apply_fills(reconcile.fill_deltas(local, remote, ["account"]), start, ["account"]).collect()}
    assert got == {"a": (974.75, 0.25), "b": (5.0, 1.0)}
    here = spark.createDataFrame([("NOK", got["a"][0]), ("BTC", got["a"][1])], "key string, amount double")
    there = spark.createDataFrame([("NOK", 850.0), ("BTC", 0.25)], "key string, amount double")
    assert {r.key: (r.matched, r.merged_amount) for r in reconcile.reconcile_balances(here, there).collect()} == {"NOK": (False, 850.0), "BTC": (True, 0.25)}


def test_fills_against_a_plain_account(spark):
    """Random orders with missing values and repeated states, one after another."""
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    rows = [(f"a{k % 3}", k, pick("buy", "sell"), pick(1.0, 2.0), pick(None, 10.0), pick("SUBMITTED", "FILLED", "PARTIALLY_FILLED"), pick(None, 0.5), None, pick(None, 0.1)) for k in range(300)]
    back = [(k, k, pick("FILLED", "PARTIALLY_FILLED", "OPEN", "filled", None), pick(None, 0.5, 1.5), pick(None, 0.0, 11.0), pick(None, 0.3)) for k in range(300)]
    money, held = {f"a{k}": 100.0 for k in range(3)}, {f"a{k}": 2.0 for k in range(3)}
    for (account, _, side, size, price, status, filled, _, fee), (_, _, now, total, paid, cost) in zip(rows, back, strict=True):
        if (now or "").upper() not in ("FILLED", "PARTIALLY_FILLED"):
            continue
        known = total if total is not None else (0.0 if status in ("FILLED", "PARTIALLY_FILLED") else size)
        delta = known - (filled or 0.0)
        if delta > 0:
            sign = 1.0 if side == "buy" else -1.0
            money[account] -= sign * delta * (paid or price or 0.0) + max(0.0, (cost or 0.0) - (fee or 0.0))
            held[account] = max(0.0, held[account] + sign * delta)
    local = spark.createDataFrame(rows, "account string, order_id long, side string, size double, price double, status string, filled_size double, fill_price double, fee double")
    remote = spark.createDataFrame(back, "order_id long, seq long, status string, filled_size double, fill_price double, fee double")
    start = spark.createDataFrame([(a, 100.0, 2.0) for a in money], "account string, balance double, position double")
    for r in reconcile.apply_fills(reconcile.fill_deltas(local, remote, ["account"]), start, ["account"]).collect():
        assert r.balance == pytest.approx(money[r.account]) and r.position == pytest.approx(held[r.account])


def test_rates_fall_back_in_order(spark):
    wanted = spark.createDataFrame([("EUR/NOK",), ("USD/NOK",), ("SEK/NOK",)], "pair string")
    stored = spark.createDataFrame([(1, "EUR/NOK", 11.0), (2, "EUR/NOK", 11.7), (3, "GBP/NOK", 13.0)], "id long, pair string, rate double")
    live = spark.createDataFrame([("USD/NOK", 10.0, 10.5), ("EUR/NOK", 1.0, 1.0)], "pair string, bid double, ask double")
    rates = lambda *a: {r.pair: (r.rate, r.origin) for r in market.fx_rates(*a).collect()}
    assert rates(wanted, stored, live, 9.5) == {"EUR/NOK": (11.7, "stored"), "USD/NOK": (10.25, "live"), "SEK/NOK": (9.5, "fallback")}
    assert rates(wanted, stored.where("false")) == {p: (1.0, "fallback") for p in ("EUR/NOK", "USD/NOK", "SEK/NOK")}


def test_made_bars_and_books(spark):
    close, want = 100.0, []
    for k in range(60):
        close += (0.6 if k % 3 else -0.2) + (0.15 if k % 5 == 0 else 0.0)
        want.append((ts(k), close, 10.0 + k))
    for r, (at, c, v) in zip(market.demo_bars(spark).orderBy("ts").collect(), want, strict=True):
        assert r.ts == at and r.close == pytest.approx(c) and r.high - r.low == pytest.approx(3.0) and r.volume == v
    books = market.demo_books(spark).orderBy("id").collect()
    assert len(books) == 6 and all(len(b.bids) == len(b.asks) == 3 for b in books)
    assert books[5].asks[0].price - books[5].bids[0].price == pytest.approx(0.85) and (books[0].bids[0].price, books[0].bids[2].size) == (pytest.approx(99.7), 0.4)


def test_outside_signals_must_be_as_many_as_bars(spark):
    b = series(spark, [1, 2, 3]).drop("signal").withColumn("exchange", F.lit("e"))
    given = spark.createDataFrame([("e", "s", ts(k), float(k)) for k in range(3)], "exchange string, symbol string, ts timestamp, signal double")
    by = ["exchange", "symbol"]
    assert [r.signal for r in indicators.with_signals(b, given, by).orderBy("ts").collect()] == [0.0, 1.0, 2.0]
    with pytest.raises(Exception, match="must be the same length"):
        indicators.with_signals(b, given.where("signal < 2"), by).collect()


def test_small_functions(spark):
    r = spark.range(1).select(
        S.numeric_entries(F.create_map(F.lit("a"), F.lit("1.5"), F.lit("b"), F.lit("x"), F.lit("c"), F.lit(None).cast("string"))).alias("m"),
        S.since_day(F.lit("2024-01-02 23:59:59").cast("timestamp"), "2024-01-02").alias("since"), S.since_day(F.lit("2024-01-01 23:59:59").cast("timestamp"), "2024-01-02").alias("before"),
        S.on_day(F.lit("2024-01-02 00:00:00").cast("timestamp"), "2024-01-02").alias("on"), F.array(*(S.venue_status(F.lit(x)) for x in (" closed", "open", "PENDING", "canceled", "odd"))).alias("status"),
    ).first()
    assert (r.m, r.since, r.before, r.on, r.status) == ({"a": 1.5}, True, False, True, ["FILLED", "OPEN", "OPEN", "CANCELED", "SUBMITTED"])


def test_report_lines_and_ranks(spark):
    day = spark.createDataFrame([(dt.date(2024, 1, 2), 3, 1.5, 0.25, 1)], "report_date date, total_trades long, total_pnl double, max_drawdown double, alert_count long")
    assert day.select(reports.summary_text()).first()[0] == "date=2024-01-02 trades=3 pnl=1.5000 drawdown=0.2500 alerts=1"
    counts = spark.createDataFrame([("e", "a", 2), ("e", "b", 5), ("e", "c", 2)], "event_type string, reason string, n long")
    assert [(r.reason, r.place) for r in reports.ranked_reasons(counts).orderBy("place").collect()] == [("b", 1), ("a", 2), ("c", 3)]
    totals = spark.createDataFrame([(1, 3), (2, 3), (3, 7), (4, 2)], "cycle long, n long").withColumn("run", F.lit("x"))
    assert [r.new for r in reports.new_trades(totals, ["run"], ["cycle"]).orderBy("cycle").collect()] == [3, 0, 4, 2]


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    rows = spark.range(5)
    for batch in (0, 1, 1):
        stream.write_once(rows, batch, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10


def test_late_ticks_are_dropped_and_counted_and_a_restart_goes_on(spark, tmp_path):
    """The second run starts from the first one's checkpoint: it reads new files alone and knows the watermark."""
    out = f"{tmp_path}/bars"

    def run(name, rows):
        tick_rows(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("id long, exchange string, symbol string, ts timestamp, bid double, ask double, last double, volume double").parquet(f"{tmp_path}/in")
        q = stream.stream_bars(source, 60, "1 minute").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    run("first", [(ts(0), 1.0, 2.0, 1.5, 1.0), (ts(10), 1.0, 2.0, 1.5, 1.0)])
    q = run("second", [(ts(1), 9.0, 9.0, 9.0, 9.0), (ts(30), 1.0, 2.0, 1.5, 1.0)])
    assert stream.late_rows(q) == 1
    got = {r.ts: r.close for r in spark.read.parquet(out).collect()}
    assert got == {ts(0): 1.5, ts(10): 1.5}
    assert not stream.is_stalled(q, 3600.0, dt.datetime.now(dt.timezone.utc).timestamp()) and stream.is_stalled(q, 1.0, dt.datetime.now(dt.timezone.utc).timestamp() + 3600)


def test_cycles_begin_at_intervals():
    waits, now = [], [0.0]

    def work():
        now[0] += 0.25 if len(waits) % 2 else 3.0

    assert stream.every(work, 1.0, 4, sleep=waits.append, clock=lambda: now[0]) == 4
    assert waits == [0.0, 0.75, 0.0]


def test_reports_of_the_command_line(tiny, capsys, spark):
    from ticksmith import cli

    rows = spark.createDataFrame([(1, ts(0)), (2, ts(1, 86_400)), (3, ts(2, 86_400))], "id long, ts timestamp")
    assert [r.id for r in cli.dated(rows, "2024-01-02", None).orderBy("id").collect()] == [2, 3]
    assert [r.id for r in cli.dated(rows, None, "2024-01-02").collect()] == [2]
    assert cli.dated(rows.drop("ts"), "2024-01-02", None).count() == 3
    assert set(cli.REPORTS["report"]) <= set(cli.catalog.queries())


def test_ungated_backtests_equal_the_fold(spark):
    """Random signals of long, short and single runs, with prices that cost nothing and prices that do."""
    rng = random.Random(11)
    rows = []
    for s in range(40):
        signal, flat = 0.0, rng.random()
        for k in range(rng.choice([1, 2, 3, 9, 40])):
            if k == 0 or rng.random() < 0.7:
                signal = rng.choice([-1.0, 1.0, 0.5]) if rng.random() > flat / 2 else 0.0
            rows.append(("e", f"s{s}", ts(k), 100 + rng.random() * 10, signal))
    b = spark.createDataFrame(rows, "exchange string, symbol string, ts timestamp, close double, signal double").repartition(3)
    variants = {"free": folds.BacktestConfig(risk=None), "costs": folds.BacktestConfig(initial_equity=50.0, costs=CostModel(taker_fee=0.2), risk=None)}
    by = ["exchange", "symbol"]
    got, want = folds.backtests(b, variants, by), folds.run_fold(b, folds.backtest_series, variants, by, ["ts"])
    assert got.schema.names == want.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    plain = lambda df: sorted(tuple("" if x is None else f"{x:.9f}" if isinstance(x, float) else str(x) for x in r) for r in df.collect())
    a, c = plain(got), plain(want)
    assert a == c and {r[2] for r in a} == {"equity", "trade", "decision"}


def test_a_feed_as_a_batch_and_as_a_stream_gives_the_same_ticks(spark, tmp_path):
    """Two runs of the stream from one checkpoint give the batch's ticks once each."""
    feeds.register(spark)
    options = {"symbols": "BTC/NOK, ETH/NOK", "seed": "5"}
    batch = spark.read.format("tick_feed").options(**options, ticks="30").load()
    want = sorted(map(tuple, batch.collect()))
    assert len(want) == 60 and all(r[4] < r[6] < r[5] for r in want) and len({r[0] for r in want}) == 60
    assert want == sorted(map(tuple, batch.collect()))
    for total in ("12", "30"):
        source = spark.readStream.format("tick_feed").options(**options, ticks="6", total=total).load()
        q = source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
    got = sorted(map(tuple, spark.read.schema(feeds.TICK_FIELDS).parquet(f"{tmp_path}/out").collect()))
    assert got == want
    with pytest.raises(Exception, match="at least one tick"):
        spark.read.format("tick_feed").option("ticks", "0").load().collect()


def test_any_python_strategy(spark):
    b = series(spark, [100, 102, 101, 105]).drop("ret")

    def rises(history, index, bar):
        if index == 0:
            return None
        return "buy" if bar["close"] > history[index - 1]["close"] else -1

    got = indicators.with_strategy(b, rises, ["symbol"]).orderBy("ts").collect()
    assert [r.signal for r in got] == [0.0, 1.0, -1.0, 1.0]
    assert indicators.for_symbol(b.withColumn("symbol", F.lit("BTC/NOK")), "btcnok").count() == 4 and indicators.for_symbol(b, "other").count() == 0


def test_a_tripped_breaker_stays_until_it_is_reset():
    gate = risk.Gate(risk.RiskConfig(), use_breaker=True)
    fine = dict(slippage=0.0, spread=0.0, stale=False, volatility=0.01, kelly=1.0)
    assert gate.evaluate(**fine, equity=100.0, peak=100.0)[2] is None
    assert gate.evaluate(**fine, equity=97.0, peak=100.0)[2] == "hard_stop_drawdown"
    assert gate.evaluate(**fine, equity=100.0, peak=100.0)[2] == "circuit_breaker"
    gate.breaker = False
    assert gate.evaluate(**fine, equity=100.0, peak=100.0)[0]
    plain = risk.Gate(risk.RiskConfig())
    assert plain.evaluate(**fine, equity=97.0, peak=100.0)[2] == "hard_stop_drawdown" and plain.evaluate(**fine, equity=100.0, peak=100.0)[2] is None


def test_unknown_words_and_parameters_are_errors(spark):
    with pytest.raises(Exception, match="unknown side"):
        spark.range(1).select(S.normalize_side(F.lit("hold"))).collect()
    registry = indicators.StrategyRegistry()
    with pytest.raises(TypeError):
        registry.resolve("momentum_breakout", nonsense=3)
    with pytest.raises(KeyError):
        registry.get("absent")
    with pytest.raises(TypeError):
        registry.register("odd", 3)
    registry.register("flat", lambda series, level=0.0: F.lit(level))
    assert spark.range(1).select(registry.resolve("flat", level=2.0)).first()[0] == 2.0
