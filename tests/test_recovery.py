"""Several remote updates of an order, one after another, against a plain account; alerts and signals that repeat."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ticksmith.operators import indicators, reconcile, reports

LOCAL = "account string, order_id long, side string, size double, price double, status string, filled_size double, fill_price double, fee double"
REMOTE = "account string, order_id long, seq long, side string, size double, price double, status string, filled_size double, fill_price double, fee double"
START = "account string, balance double, position double"


def test_half_then_whole(spark):
    """0.5 of 1.0, then all of it: the position is 1, not 1.5, and the balance 899.8."""
    local = spark.createDataFrame([("a", 1, "buy", 1.0, 100.0, "SUBMITTED", None, None, None)], LOCAL)
    remote = spark.createDataFrame([("a", 1, 1, "buy", 1.0, None, "partially_filled", 0.5, 100.0, 0.1), ("a", 1, 2, "buy", 1.0, None, "filled", 1.0, 100.0, 0.2)], REMOTE)
    start = spark.createDataFrame([("a", 1000.0, 0.0)], START)
    r = reconcile.apply_fills(reconcile.fill_deltas(local, remote, ["account"]), start, ["account"]).first()
    assert (r.position, r.balance) == (1.0, pytest.approx(899.8))
    assert [tuple(x) for x in reconcile.recover_orders(local, remote).collect()] == [(1, "buy", 1.0, "FILLED", 1.0, 100.0, 0.2, True, False)]
    assert [(x.remote_status, x.filled_size, x.fee) for x in reconcile.reconcile_orders(local, remote).collect()] == [("filled", 1.0, 0.2)]


TAKEN = ("FILLED", "PARTIALLY_FILLED")


class Account:
    """Orders as objects, updates as calls: what the columns must equal."""

    def __init__(self, local):
        self.orders = {o[1]: dict(zip(LOCAL_NAMES, o, strict=True)) | {"known": True} for o in local}
        self.money, self.held = {}, {}

    def update(self, account, order_id, seq, side, size, price, status, filled, paid, fee):
        status = (status or "").upper() or None
        o = self.orders.get(order_id)
        if o is None:
            o = self.orders[order_id] = dict(zip(LOCAL_NAMES, (account, order_id, side or "unknown", size or 0.0, price, status or "SUBMITTED", filled, paid, fee or 0.0), strict=True)) | {"known": False}
        was, had, cost = o["status"], o["filled_size"] or 0.0, o["fee"] or 0.0
        for name, value in (("status", status), ("filled_size", filled), ("fill_price", paid), ("fee", fee)):
            if value is not None:
                o[name] = value
        if status not in TAKEN or o["side"] not in ("buy", "sell"):
            return
        now = filled if filled is not None else 0.0 if was in TAKEN else o["size"]
        if now - had > 0:
            sign, a = 1.0 if o["side"] == "buy" else -1.0, o["account"]
            self.money[a] = self.money[a] - sign * (now - had) * (paid or o["price"] or 0.0) - max(0.0, (fee or 0.0) - cost)
            self.held[a] = max(0.0, self.held[a] + sign * (now - had))


LOCAL_NAMES = [c.split()[0] for c in LOCAL.split(", ")]


@pytest.mark.parametrize("split", [10**6, 20])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_updates_equal_a_plain_account(spark, seed, split):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    local = [(f"a{k % 3}", k, pick("buy", "sell"), pick(1.0, 2.0), pick(None, 10.0), pick("SUBMITTED", "FILLED", "PARTIALLY_FILLED"), pick(None, 0.5), None, pick(None, 0.1)) for k in range(60)]
    # order 7 has most updates; orders from 60 on are the venue's only, of size 1 and known account
    made = {}
    updates = []
    for seq in range(500):
        k = pick(7, 7, rng.randrange(80))
        side, size = made.setdefault(k, (pick("buy", "sell"), 1.0))
        updates.append((f"a{k % 3}", k, seq, side, size, 9.0, pick("FILLED", "PARTIALLY_FILLED", "OPEN", "filled", None, ""), pick(None, 0.5, round(seq / 100, 2)), pick(None, 0.0, 11.0), pick(None, round(seq / 1000, 3))))
    plain = Account(local)
    plain.money, plain.held = {f"a{k}": 100.0 for k in range(3)}, {f"a{k}": 2.0 for k in range(3)}
    for u in updates:
        plain.update(*u)
    a, b = spark.createDataFrame(local, LOCAL), spark.createDataFrame(updates, REMOTE).repartition(8)
    start = spark.createDataFrame([(x, 100.0, 2.0) for x in plain.money], START)
    for r in reconcile.apply_fills(reconcile.fill_deltas(a, b, ["account"], split), start, ["account"], split).collect():
        assert r.balance == pytest.approx(plain.money[r.account]) and r.position == pytest.approx(plain.held[r.account])
    for r in reconcile.recover_orders(a, b).collect():
        o = plain.orders[r.order_id]
        assert (r.side, r.size, r.status, r.filled_size, r.fill_price, r.fee, r.inserted) == (o["side"], o["size"], o["status"], o["filled_size"], o["fill_price"], o["fee"], not o["known"])
    states = {(r.order_id, r.seq): r for r in reconcile.order_states(a, b, ["account"], split).collect()}
    assert len(states) == len(updates)


def test_the_venues_snapshot_wins_after_updates(spark):
    local = spark.createDataFrame([("a", 1, "buy", 0.25, 100.0, "SUBMITTED", None, None, None)], LOCAL)
    remote = spark.createDataFrame([("a", 1, 1, "buy", 0.25, None, "FILLED", 0.25, 100.0, 0.25)], REMOTE)
    start = spark.createDataFrame([("a", 1000.0, 0.0), ("b", 5.0, 1.0)], START)
    snapshot = spark.createDataFrame([("a", 850.0, 0.25), ("c", None, 3.0)], START)
    got = {r.account: (r.local_balance, r.local_position, r.matched, r.balance, r.position) for r in reconcile.recover_accounts(local, remote, start, snapshot, ["account"]).collect()}
    assert got == {"a": (974.75, 0.25, False, 850.0, 0.25), "b": (5.0, 1.0, False, 5.0, 1.0), "c": (None, None, False, None, 3.0)}


def test_a_kill_switch_cancels_what_can_still_change(spark):
    orders = spark.createDataFrame([(1, "OPEN"), (2, "FILLED"), (3, "SUBMITTED"), (4, None)], "order_id long, status string")
    got = {r.order_id: (r.status, r.stopped) for r in reconcile.kill_switch(orders, F.col("order_id") != 3).collect()}
    assert got == {1: ("CANCELED", True), 2: ("FILLED", False), 3: ("SUBMITTED", False), 4: ("CANCELED", True)}


def test_an_id_that_occurs_twice_blocks_once_each(spark):
    """Two rows of one id are two events; neither is doubled."""
    meta = '{"allowed": false, "reason": "spread_limit", "status": "x"}'
    events = spark.createDataFrame([(1, "s", 1, "entry_decision", meta), (1, "s", 2, "order_lifecycle", meta)], "id long, source string, day int, event_type string, metadata string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert [tuple(r) for r in reports.risk_stops(events, ["source"], "day").collect()] == [("s", 1, 1, "spread_limit", True)]
    assert "Join" not in reports.risk_stops(events, ["source"], "day")._jdf.queryExecution().optimizedPlan().toString()


def test_two_signals_of_one_time_are_an_error(spark):
    at = [dt.datetime(2024, 1, 1, h) for h in range(3)]
    bars = spark.createDataFrame([("e", at[0], 1.0), ("e", at[1], 2.0)], "exchange string, ts timestamp, close double")
    given = spark.createDataFrame([("e", at[0], 1.0), ("e", at[0], -1.0)], "exchange string, ts timestamp, signal double")
    with pytest.raises(Exception, match="two signals or bars of one time"):
        indicators.with_signals(bars, given, ["exchange"]).collect()
    moved = spark.createDataFrame([("e", at[0], 1.0), ("e", at[2], -1.0)], "exchange string, ts timestamp, signal double")
    got = indicators.with_signals(bars, moved, ["exchange"])
    assert got.columns == ["exchange", "ts", "close", "signal"]
    assert [tuple(r) for r in got.orderBy("ts").collect()] == [("e", at[0], 1.0, 1.0), ("e", at[1], 2.0, None)]


def test_times_are_utc_in_any_session(spark):
    from ticksmith.functions import scalars as S

    texts = ["2024-01-02 23:30:00", "2024-01-02T23:30:00Z", "2024-01-03T01:30:00+02:00", "2024-01-02", "bad", None]
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    try:
        for other in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            r = [(x.s, x.day) for x in rows.select("k", F.unix_seconds(S.parse_timestamp(F.col("t"))).alias("s"), S.on_day(S.parse_timestamp(F.col("t")), "2024-01-02").alias("day")).orderBy("k").collect()]
            assert r == [(1704238200, True)] * 3 + [(1704153600, True), (None, None), (None, None)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
