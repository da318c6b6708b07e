"""Scans that split hot keys and the as-of join, against plain loops; a key on many partitions gives the same rows."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ticksmith.operators import analytics, folds, scans, trades
from ticksmith.plans import catalog

SPLITS = [10**6, 25]


def ts(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("split", SPLITS)
@pytest.mark.parametrize("by", [["key"], []])
def test_running_values_equal_a_loop(spark, by, split):
    """Ties in time, nulls in values, times and keys; one key has most rows."""
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(60)]), rng.choice([-2, -1, 1, 2]), rng.choice([None, 1.5, float(k)])) for k in range(400)]
    v, x = F.col("v"), F.col("x")
    given = {"s": ("sum", v), "hi": ("max", x), "lo": ("min", x), "first": ("first", x), "la": ("last", x), "lb": ("last_before", x), "low": ("low", v), "before": ("low_before", v)}
    df = spark.createDataFrame(rows, "id long, key string, t long, v long, x double")
    out = scans.with_running(df, by, ["t", "id"], given, split, 8)
    assert out.columns == [*df.columns, *given]
    got = {r.id: tuple(r[c] for c in given) for r in out.collect()}
    want, state = {}, {}
    for id_, key, t, v, x in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        k = key if by else 0
        s, hi, lo, first, la, low = state.get(k, (0, None, None, None, None, None))
        before, lb = low, la
        s += v
        low = s if low is None else min(low, s)
        if x is not None:
            hi, lo, first, la = x if hi is None else max(hi, x), x if lo is None else min(lo, x), x if first is None else first, x
        state[k] = (s, hi, lo, first, la, low)
        want[id_] = (s, hi, lo, first, la, lb, low, before)
    assert got == want


def test_a_hot_key_is_many_tasks(spark):
    """With one key for all rows, no chunk has more than its share."""
    df = spark.range(4000).select(F.lit("all").alias("key"), F.col("id").alias("t"))
    chunks = lambda split: scans._with_chunks(df, ["key"], "t", scans._hot_keys(df, ["key"], split), 8)
    sizes = [r[0] for r in chunks(100).groupBy(scans._CHUNK).count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) < 700
    assert [r[0] for r in chunks(4000).select(scans._CHUNK).distinct().collect()] == [0]
    running = lambda split: scans.with_running(df, ["key"], ["t"], {"s": ("sum", F.col("t"))}, split, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in running(100) and "Join" not in running(4000)
    with pytest.raises(ValueError, match="unknown kinds"):
        scans.with_running(df, ["key"], ["t"], {"x": ("median", F.col("t"))})


def test_totals_and_scan_take_the_same_chunks(spark, monkeypatch):
    """Approximate percentiles that come out otherwise each time, as they do when parts arrive in another order."""
    plain = F.percentile_approx
    other = F.udf(lambda ends: sorted(random.SystemRandom().sample(range(1000), len(ends))), "array<bigint>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda *args: other(plain(*args)))
    df = spark.range(1000).select((F.col("id") % 2).alias("key"), F.col("id").alias("t"), F.when(F.col("id") % 11 < 2, F.col("id")).alias("x"))
    got = scans.with_running(df, ["key"], ["t"], {"s": ("sum", F.lit(1)), "la": ("last", F.col("x"))}, 100, 8).collect()
    assert len(got) == 1000
    for r in got:
        known = [t for t in range(r.t, -1, -2) if t % 11 < 2]
        assert (r.s, r.la) == (r.t // 2 + 1, known[0] if known else None)


@pytest.mark.parametrize("split", SPLITS)
def test_one_hot_pair_gives_the_same_trips_accounts_and_drawdowns(spark, split):
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 9 + ["cold", None]), ts(rng.randrange(200)), k, rng.choice(["buy", "sell", "sell"]), float(k), float(rng.randrange(1, 5)), 0.25) for k in range(600)]
    fills = spark.createDataFrame(rows, "pair string, ts timestamp, id long, side string, price double, size double, fee double").repartition(8)
    queues, trips, held = {}, [], {}
    states = {}
    for pair, t, k, side, price, size, fee in sorted(rows, key=lambda r: (r[1], r[2])):
        q = queues.setdefault(pair, [])
        position, money = held.get(pair, (0.0, 0.0))
        if side == "buy":
            q.append(k)
            position, money = position + size, money - price * size - fee
        else:
            if q:
                trips.append((pair, q.pop(0), k, size))
            position, money = max(0.0, position - size), money + price * size - fee
        held[pair] = (position, money)
        states[k] = (position, money)
    got = trades.round_trips(fills, ["pair"], ["ts", "id"], split).select("pair", "entry_price", "exit_price", "size").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((p, float(a), float(b), s)) for p, a, b, s in trips)
    left = trades.open_positions(fills, ["pair"], ["ts", "id"], split).select("pair", "price").collect()
    assert sorted((str(r.pair), r.price) for r in left) == sorted((str(p), float(k)) for p, q in queues.items() for k in q)
    account = {r.id: (r.position, pytest.approx(r.balance_change)) for r in folds.account_state(fills, ["pair"], ["ts", "id"], split).collect()}
    assert account == states
    curve = fills.select("pair", "ts", "id", (F.col("price") % 97 + 1).alias("equity"))
    peaks, want = {}, {}
    for r in sorted(curve.collect(), key=lambda r: (r.ts, r.id)):
        top, low = peaks.get(r.pair, (0.0, 1e9))
        peaks[r.pair] = top, low = max(top, r.equity), min(low, r.equity)
        want[r.id] = (top, low, (top - r.equity) / top)
    assert {r.id: (r.peak, r.trough, r.drawdown) for r in analytics.with_running_drawdown(curve, ["pair"], ["ts", "id"], split).collect()} == want


@pytest.mark.parametrize("split", SPLITS)
@pytest.mark.parametrize("strictly", [False, True])
@pytest.mark.parametrize("tolerance", [None, 7])
def test_asof_equals_a_search(spark, split, strictly, tolerance):
    rng = random.Random(5)
    key = lambda: rng.choice(["a", "a", "a", "b", None])
    left = [(k, key(), rng.choice([None, *map(ts, range(300))])) for k in range(120)]
    right = [(k, key(), rng.choice([None, *map(ts, range(300))]), rng.choice([None, float(k)])) for k in range(150)]
    got = scans.asof(spark.createDataFrame(left, "n long, key string, ts timestamp"), spark.createDataFrame(right, "id long, key string, ts timestamp, price double"), ["key"], values=["price", "id"], order=["id"], tolerance_seconds=tolerance, strictly=strictly, split_rows=split, pieces=8)
    assert got.columns == ["n", "key", "ts", "right_ts", "price", "id"]
    for r in got.collect():
        fits = [x for x in right if r.ts and x[1] == r.key and x[2] and (x[2] < r.ts if strictly else x[2] <= r.ts)]
        best = max(fits, key=lambda x: (x[2], x[0]), default=None)
        if best and tolerance is not None and (r.ts - best[2]).total_seconds() > tolerance:
            best = None
        assert (r.right_ts, r.price, r.id) == ((best[2], best[3], best[0]) if best else (None, None, None))
    assert got.count() == len(left)


def test_asof_without_keys_and_with_empty_sides(spark):
    days = spark.createDataFrame([(ts(10),), (ts(20),)], "ts timestamp")
    seen = spark.createDataFrame([(ts(5), 1.0), (ts(20), 2.0)], "ts timestamp, equity double")
    assert sorted(tuple(r) for r in scans.asof(days, seen, [], strictly=True).collect()) == [(ts(10), ts(5), 1.0), (ts(20), ts(5), 1.0)]
    assert [r.equity for r in scans.asof(days, seen.where("false"), []).collect()] == [None, None]
    assert scans.asof(days.where("false"), seen, []).collect() == []


def test_starting_equity_and_marks(spark):
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    curve = spark.createDataFrame([("s", at(1, 1), 1, 10.0), ("s", at(1, 9), 2, 12.0), ("s", at(3, 0), 3, 11.0), ("s", at(3, 5), 4, 9.0), ("t", at(3, 1), 5, 7.0)], "source string, ts timestamp, id long, equity double")
    got = {(r.source, r.day.day): (r.previous, r.starting) for r in analytics.starting_equity(curve, ["source"]).collect()}
    assert got == {("s", 1): (None, 1000.0), ("s", 3): (at(1, 9), 12.0), ("t", 3): (None, 1000.0)}
    snapshots = spark.createDataFrame([("B", ts(60), 100.0, 2.0, None), ("B", ts(5), 100.0, 2.0, 4.0), ("E", ts(60), 100.0, 2.0, 4.0)], "symbol string, ts timestamp, cash double, position_size double, avg_entry_price double")
    ticks = spark.createDataFrame([(1, "B", ts(0), 9.0, None), (2, "B", ts(60), 8.0, 10.0), (3, "B", ts(60), None, 11.0)], "id long, symbol string, ts timestamp, bid double, last double")
    got = {(r.symbol, r.ts): (r.quoted, r.mark, r.equity, r.unrealized_pnl) for r in analytics.marks_at(snapshots, ticks, 30).collect()}
    assert got == {("B", ts(60)): (ts(60), 11.0, 122.0, 0.0), ("B", ts(5)): (ts(0), 9.0, 118.0, 10.0), ("E", ts(60)): (None, None, 100.0, None)}


def test_trailing_and_window_gains(spark):
    rows = [(k, "s", ts(600 * k - (k % 2) * 600), float(k * k % 37)) for k in range(60)]
    curve = spark.createDataFrame(rows, "id long, source string, ts timestamp, equity double")
    got = {r.id: (r.pnl, r.oldest) for r in analytics.trailing_pnl(curve, ["source"], 4, 3600).collect()}
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    for i, r in enumerate(ordered):
        old = next(x for x in ordered[max(0, i - 3) : i + 1] if (r[2] - x[2]).total_seconds() <= 3600)
        assert got[r[0]] == (r[3] - old[3], old[2])
    for w in analytics.window_pnl(curve, ["source"], 3600, 1200).collect():
        own = [r for r in ordered if w.start <= r[2] < w.end]
        assert (w.pnl, w.peak, w.trough, w.snapshots) == (own[-1][3] - own[0][3], max(r[3] for r in own), min(r[3] for r in own), len(own))
    with pytest.raises(ValueError, match="slides"):
        analytics.window_pnl(curve, ["source"], 60, 120)


@pytest.mark.parametrize("snapshots", [1, 3, 70, 1000])
def test_trailing_gains_of_a_hot_series(spark, snapshots):
    """Frames longer than chunks, ties, and rows without a time or source."""
    rng = random.Random(4)
    rows = [(k, rng.choice(["hot", "hot", "hot", "cold", None]), rng.choice([None, *(ts(20 * s) for s in range(150))]), float(rng.randrange(90))) for k in range(500)]
    curve = spark.createDataFrame(rows, "id long, source string, ts timestamp, equity double").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[2] is not None, r[2] or ts(0), r[0]))
    for split in SPLITS:
        out = analytics.trailing_pnl(curve, ["source"], snapshots, 900, split_rows=split)
        assert out.columns == ["id", "source", "ts", "equity", "pnl", "oldest"]
        got = {r.id: (r.pnl, r.oldest) for r in out.collect()}
        assert len(got) == len(rows)
        for source in ("hot", "cold", None):
            own = [r for r in ordered if r[1] == source]
            for i, r in enumerate(own):
                old = next(x for x in own[max(0, i + 1 - snapshots) : i + 1] if r[2] is None or x[2] is not None and (r[2] - x[2]).total_seconds() <= 900)
                assert got[r[0]] == (r[3] - old[3], old[2])


def test_no_frame_of_trailing_gains_grows_with_time(spark):
    """A sliding frame is summed up anew for each row, so one that holds all rows of some hours is quadratic in them."""
    curve = spark.createDataFrame([(1, "s", ts(0), 1.0)], "id long, source string, ts timestamp, equity double")
    assert "RangeFrame" not in analytics.trailing_pnl(curve, ["source"], 20, 3600)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seconds", [0, 20, 900, 10**6])
def test_trailing_gains_over_all_rows_of_the_time(spark, seconds):
    """Without a number of snapshots all within the time count, ties and rows without a time or source too."""
    rng = random.Random(6)
    rows = [(k, rng.choice(["hot", "hot", "hot", "cold", None]), rng.choice([None, *(ts(20 * s) for s in range(150))]), rng.choice([None, *map(float, range(90))])) for k in rng.sample(range(900), 500)]
    curve = spark.createDataFrame(rows, "id long, source string, ts timestamp, equity double").repartition(5)
    for by in (["source"], []):
        for split in SPLITS:
            out = analytics.trailing_pnl(curve, by, seconds=seconds, split_rows=split)
            assert out.columns == ["id", "source", "ts", "equity", "pnl", "oldest"]
            got = out.collect()
            assert sorted(tuple(r[:4]) for r in got if r.ts and r.source and r.equity) == sorted(r for r in rows if r[1] and r[2] and r[3]) and len(got) == len(rows)
            for r in got:
                own = [x for x in rows if (not by or x[1] == r.source) and (x[2] is None if r.ts is None else x[2] is not None and 0 <= (r.ts - x[2]).total_seconds() <= seconds)]
                old = min(own, key=lambda x: (x[2] or ts(0), x[0]))
                assert (r.pnl, r.oldest) == (None if r.equity is None or old[3] is None else r.equity - old[3], old[2])


def test_the_query_of_trailing_gains_has_no_bound_of_rows(spark, tmp_path):
    """A hundred snapshots of two hours: the first is the oldest of all, for the query and its SQL."""
    rows = [(k, ts(60 * k), 1, "s", float(k * k), "{}") for k in range(100)] + [(100, ts(21600), 1, "s", 7.0, "{}"), (101, ts(21601), 1, "s", 8.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    want = {k: (float(k * k), ts(0)) for k in range(100)} | {100: (7.0, ts(0)), 101: (7.0, ts(60))}
    assert {r.id: (r.pnl, r.oldest) for r in catalog.queries()["trailing_pnl"](spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert {r[0]: r[4:] for r in con.execute(catalog.oracle_sql()["trailing_pnl"]).fetchall()} == want


def test_all_rows_of_a_time_take_one_scan_and_chunks(spark):
    """No sliding frame and no list of rows; a hot series is cut."""
    curve = spark.range(200).select("id", F.lit("s").alias("source"), F.timestamp_seconds("id").alias("ts"), F.lit(1.0).alias("equity"))
    plan = lambda split: analytics.trailing_pnl(curve, ["source"], split_rows=split)._jdf.queryExecution().optimizedPlan().toString()
    for split in (50, 10**6):
        assert "RangeFrame" not in plan(split) and "collect_list" not in plan(split)
    assert "_chunk" in plan(50) and "_chunk" not in plan(10**6)


def test_a_frame_takes_rows_of_many_chunks(spark):
    df = spark.range(400).select((F.col("id") / 399).cast("long").alias("key"), (F.col("id") / 3).cast("long").alias("t"), "id")
    for by in (["key"], []):
        for split in SPLITS:
            got = {r.id: (r.n, r.oldest) for r in scans.with_trailing(df, by, ["t", "id"], 150, {"n": F.count("*"), "oldest": F.min("id")}, split, 8).collect()}
            assert got == {k: (1, 399) if by and k == 399 else (min(k + 1, 150), max(0, k - 149)) for k in range(400)}
    with pytest.raises(ValueError, match="one row"):
        scans.with_trailing(df, ["key"], ["t"], 0, {})


def test_streamed_backtests_equal_whole_series(spark, monkeypatch):
    """Series of one bar and of many, over batches of ten rows, with what is held given out every few rows."""
    rng = random.Random(2)
    sizes = {"one": 1, "two": 2, "many": 90}
    rows = [(s, ts(60 * k), 100 + 10 * rng.random(), float(rng.choice([-1, 0, 1, 1])), 0.01 * rng.random(), 0.01, False, 0.05 * rng.random(), rng.random()) for s, n in sizes.items() for k in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, signal double, slippage_pct double, spread_pct double, stale boolean, volatility_pct double, kelly double")
    variants = {"gated": folds.BacktestConfig(), "costs": folds.BacktestConfig(costs=folds.CostModel(taker_fee=0.2))}
    want = sorted(map(str, folds.run_fold(bars, folds.backtest_series, variants, ["symbol"], ["ts"]).collect()))
    monkeypatch.setattr(folds, "_FLUSH", 7)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = sorted(map(str, folds.backtests(bars.repartition(3), variants, ["symbol"]).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == want and len(got) > 180
