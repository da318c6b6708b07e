"""Path-dependent runs as keyed ordered folds: backtests, paper orders and depth-aware fills.

A fold's next state depends on its last, so a series can't be split; series, variants and walk-forward folds run in
parallel. Gated backtests stream a series' bars through one task; order simulators are one grouped-map call a series.
Backtests without a risk gate aren't path-dependent, and are windows. Everything that depends on bars alone comes in as
columns. Output is one tagged schema (``schemas.FOLD``); callers filter by ``kind``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticksmith.functions.costs import CostModel
from ticksmith.operators.risk import Gate, RiskConfig
from ticksmith.operators.scans import SPLIT_ROWS, reflected, with_running
from ticksmith.schemas import FOLD

_NAMES = [c.split()[0] for c in FOLD.split(", ")]


class _Rows:
    """Tagged output rows, by column."""

    def __init__(self, series: str, variant: str):
        self.head = {"series": series, "variant": variant}
        self.rows: list[dict] = []
        self.count: dict[str, int] = {}

    def add(self, kind: str, **values) -> None:
        seq = self.count.get(kind, 0)
        self.count[kind] = seq + 1
        self.rows.append(self.head | {"kind": kind, "seq": seq} | values)

    def frame(self) -> pd.DataFrame:
        # plain objects: Arrow takes each column's kind from the declared schema
        out = pd.DataFrame(self.rows, columns=_NAMES, dtype=object)
        out["ts"] = pd.to_datetime(out["ts"])
        return out


@dataclass(frozen=True)
class BacktestConfig:
    initial_equity: float = 100.0
    costs: CostModel | None = None
    risk: RiskConfig | None = field(default_factory=RiskConfig)


class _Backtest:
    """One position at a time, fully invested by the gate's size; opens and closes at closes, equity moves on exits.

    The first bar only starts the series. A signal that is opposed or zero closes; the last bar closes what is open,
    and may open what nothing closes. A bar makes one transition at most. All state is here, so bars can stream.
    """

    def __init__(self, config: BacktestConfig, out: _Rows):
        self.out, self.costs = out, config.costs
        self.gate = Gate(config.risk) if config.risk else None
        self.equity = self.peak = config.initial_equity
        self.position, self.entry, self.size, self.begun = 0, 0.0, 1.0, False

    def _price(self, price: float, side: str) -> float:
        return self.costs.price(price, side) if self.costs else price

    def step(self, bar: dict, last: bool) -> None:
        """Take the next bar; ``last``: none follows. A series of one bar gives nothing."""
        if not self.begun:
            self.begun = True
            if not last:
                self.out.add("equity", ts=bar["ts"], equity=self.equity)
            return
        close, signal, ts = bar["close"], bar["signal"], bar["ts"]
        if self.position and (last or signal * self.position <= 0):
            exit_price = self._price(close, "sell" if self.position > 0 else "buy")
            ret = self.position * (exit_price - self.entry) / self.entry
            self.equity *= 1 + self.size * ret
            self.out.add("trade", ts=ts, side="long" if self.position > 0 else "short", entry_price=self.entry, exit_price=exit_price, size=self.size, return_pct=ret, equity=self.equity, cost=abs(exit_price - close) + abs(self.entry - close))
            self.position = 0
        elif not self.position:
            allowed, risk_size, reason = True, 1.0, None
            side = "buy" if signal > 0 else "sell" if signal < 0 else None
            if self.gate:
                allowed, risk_size, reason = self.gate.evaluate(slippage=bar["slippage_pct"], spread=bar["spread_pct"], stale=bar["stale"], volatility=bar["volatility_pct"], kelly=bar["kelly"], equity=self.equity, peak=self.peak, side=side)
            if side:
                self.out.add("decision", ts=ts, side=side, allowed=allowed, reason=reason, size=risk_size, price=close)
            if side and allowed:
                self.position, self.entry, self.size = (1 if signal > 0 else -1), self._price(close, side), risk_size
            else:
                self.size = 1.0
        self.peak = max(self.peak, self.equity)
        self.out.add("equity", ts=ts, equity=self.equity)


_GATE_INPUTS = ["slippage_pct", "spread_pct", "stale", "volatility_pct", "kelly"]


def backtest_series(rows: pd.DataFrame, config: BacktestConfig, out: _Rows) -> None:
    """All bars of a series at once."""
    run = _Backtest(config, out)
    names = ["ts", "close", "signal", *(_GATE_INPUTS if config.risk else [])]
    bars = zip(*(rows[n].tolist() for n in names), strict=True)
    for i, bar in enumerate(bars):
        run.step(dict(zip(names, bar, strict=True)), i == len(rows) - 1)


#: Rows that a streamed fold holds before it gives them out.
_FLUSH = 20_000


def stream_backtests(bars: DataFrame, variants: dict[str, BacktestConfig], by: list[str]) -> DataFrame:
    """Gated backtests of every variant over every series, with bounded memory.

    A gate needs the run so far, so a series is one task's, but its bars stream through in order: what is held is a batch,
    the state, and one bar, until it is known whether another follows.
    """
    names = ["ts", "close", "signal", *_GATE_INPUTS]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold, out, held = None, None, None, None
        for frame in frames:
            for series, variant, *values in zip(*(frame[n].tolist() for n in ["series", "variant", *names]), strict=True):
                if (series, variant) != key:
                    if fold:
                        fold.step(held, True)
                        yield out.frame()
                    key, out = (series, variant), _Rows(series, variant)
                    fold = _Backtest(variants[variant], out)
                else:
                    fold.step(held, False)
                    if len(out.rows) >= _FLUSH:
                        yield out.frame()
                        out.rows.clear()
                held = dict(zip(names, values, strict=True))
        if fold:
            fold.step(held, True)
            yield out.frame()

    keyed = bars.select(F.concat_ws("|", *by).alias("series"), F.explode(F.array(*map(F.lit, variants))).alias("variant"), *names)
    dealt = keyed.repartition("series", "variant").sortWithinPartitions("series", "variant", "ts")
    return dealt.mapInPandas(run, FOLD)


@dataclass(frozen=True)
class PaperConfig:
    """``execution`` sandbox fills at once; ``legacy_partial`` leaves partly filled orders as they are."""

    initial_cash: float = 100.0
    default_order_size: float = 1.0
    partial_fill_fraction: float = 1.0
    max_order_lifetime_bars: int = 2
    costs: CostModel = field(default_factory=CostModel)
    risk: RiskConfig | None = None
    exchange: str = "paper"
    circuit_breaker: bool = False
    kill_switch: bool = False
    execution: str = "paper"
    legacy_partial: bool = False

    def __post_init__(self) -> None:
        if self.initial_cash <= 0 or self.default_order_size <= 0:
            raise ValueError("initial cash and order size must be positive")
        if not 0 < self.partial_fill_fraction <= 1:
            raise ValueError("the partial fill must be above 0 and at most 1")
        if self.max_order_lifetime_bars < 1:
            raise ValueError("an order must live for a bar at least")


@dataclass
class _Order:
    id: str
    ts: object
    side: str
    size: float
    status: str = "PENDING_SUBMIT"
    filled: float = 0.0
    price: float | None = None
    fees: float = 0.0
    age: int = 0
    reason: str | None = None

    @property
    def open_size(self) -> float:
        return max(0.0, self.size - self.filled)


class _Account:
    def __init__(self, cash: float):
        self.cash, self.size, self.entry, self.fees, self.realized = cash, 0.0, None, 0.0, 0.0

    def fill(self, side: str, size: float, price: float, realize: bool = True) -> bool:
        if side == "buy" and self.cash >= price * size:
            self.cash -= price * size
            self.size += size
            if self.size <= 0:
                self.entry = None
            else:
                self.entry = price if self.entry is None else (self.entry * (self.size - size) + price * size) / self.size
        elif side == "sell" and self.size >= size:
            if realize:
                self.realized += (price - (self.entry or price)) * size
            self.cash += price * size
            self.size -= size
            if self.size <= 0:
                self.entry = None
        else:
            return False
        return True


def paper_series(rows: pd.DataFrame, config: PaperConfig, out: _Rows) -> None:
    """Orders are sent on one bar, open on the next and fill at closes from then on; equity is marked on each bar."""
    account, peak = _Account(config.initial_cash), config.initial_cash
    gate = Gate(config.risk, config.exchange, config.circuit_breaker) if config.risk else None
    col = {n: rows[n].tolist() for n in ("ts", "close", "signal")}
    if gate:
        col |= {n: rows[n].tolist() for n in ("slippage_pct", "spread_pct", "stale", "volatility_pct", "kelly")}
    orders: list[_Order] = []
    active: list[_Order] = []

    def trade(order: _Order, ts, size: float, price: float, cost: float) -> None:
        out.add("trade", ts=ts, order_id=order.id, side=order.side, price=price, size=size, cost=cost, fees=cost)

    def send(ts, side: str, size: float, price: float) -> None:
        order = _Order(f"order-{len(orders) + 1}", ts, side, size)
        orders.append(order)
        if config.execution == "sandbox":  # filled at once at the bar's price; the fee stays with the adapter
            if account.fill(side, size, price, realize=False):
                order.status, order.filled, order.price = "FILLED", size, price
                trade(order, ts, size, price, 0.0)
            else:
                order.status, order.reason = "CANCELED", "insufficient_cash_or_position"
        else:
            active.append(order)

    for i in range(len(rows)):
        ts, price, signal = col["ts"][i], col["close"][i], col["signal"][i]
        equity = account.cash + account.size * price
        for order in list(active):
            if order.status == "PENDING_SUBMIT":
                order.status = "OPEN"
                continue
            if order.status != "OPEN" and (config.legacy_partial or order.status != "PARTIALLY_FILLED"):
                continue
            order.age += 1
            if order.age >= config.max_order_lifetime_bars:
                order.status, order.reason = "CANCELED", "max_order_lifetime_bars"
                active.remove(order)
                continue
            size = min(order.open_size, config.default_order_size * config.partial_fill_fraction)
            if size <= 0:
                continue
            paid = config.costs.price(price, order.side, size)
            cost = abs(paid - price) * size
            account.fees += cost
            if not account.fill(order.side, size, paid):
                order.status, order.reason = "CANCELED", "insufficient_cash_or_position"
                active.remove(order)
                continue
            order.filled, order.price, order.fees = order.filled + size, paid, order.fees + cost
            if order.open_size <= 0:
                order.status = "FILLED"
                active.remove(order)
            else:
                order.status = "PARTIALLY_FILLED"
            trade(order, ts, size, paid, cost)

        if not active:
            if account.size > 0 and signal < 0:
                send(ts, "sell", account.size, price)
            elif signal > 0 and account.size <= 0 or signal < 0 and account.size >= 0:
                side = "buy" if signal > 0 else "sell"
                if config.kill_switch:
                    allowed, size, reason = False, 0.0, "kill_switch"
                elif gate is None:
                    allowed, size, reason = True, config.default_order_size, None
                else:
                    held = int(account.size != 0)
                    allowed, size, reason = gate.evaluate(slippage=col["slippage_pct"][i], spread=col["spread_pct"][i], stale=col["stale"][i], volatility=col["volatility_pct"][i], kelly=col["kelly"][i], equity=equity, peak=peak, side=side, position=account.size, open_positions=held, notional=max(0.0, account.size * price))
                out.add("decision", ts=ts, side=side, allowed=allowed, reason=reason, size=size, price=price, cash=account.cash, equity=equity, position_size=account.size)
                if allowed and price > 0 and account.cash > 0:
                    most = [config.default_order_size, size, account.cash / price]
                    if config.risk and config.risk.risk_per_trade_pct > 0:
                        most.append(equity * config.risk.risk_per_trade_pct / price)
                    if (wanted := max(0.0, min(most))) > 0:
                        send(ts, side, wanted, price)

        equity = account.cash + account.size * price
        peak = max(peak, equity)
        paper = account.size * price - account.size * (account.entry or 0.0) if account.size else 0.0
        out.add("equity", ts=ts, equity=equity, cash=account.cash, position_size=account.size, avg_entry_price=account.entry, unrealized_pnl=paper, realized_pnl=account.realized, fees=account.fees, price=price, side="long" if account.size > 0 else "short" if account.size < 0 else "flat")
    for o in orders:
        out.add("order", ts=o.ts, order_id=o.id, side=o.side, status=o.status, size=o.size, filled_size=o.filled, price=o.price, fees=o.fees, reason=o.reason)


@dataclass(frozen=True)
class SimulatorConfig:
    latency_ms: int = 100
    max_slippage: float = 0.01
    initial_equity: float = 100.0
    position_size: float = 1.0
    costs: CostModel = field(default_factory=CostModel)
    queue_penalty: float = 0.0
    impact_penalty: float = 0.0
    adverse_penalty: float = 0.0


def simulate_series(rows: pd.DataFrame, config: SimulatorConfig, out: _Rows) -> None:
    """Signals against books: orders wait for the latency in steps of 100 ms, then take what the depth gives.

    A queued order keeps its remainder, one that is executed at once drops it. The equity curve has a point before the
    first book.
    """
    cash, size, entry = config.initial_equity, 0.0, None
    wait = max(0, config.latency_ms // 100)
    pending: dict | None = None
    before = None
    out.add("equity", ts=None, equity=cash)

    def fill(levels: list, best: float, side: str, wanted: float, mid: float) -> tuple[float, float]:
        left, value, filled = wanted, 0.0, 0.0
        for k, (p, q) in enumerate(levels):
            if left <= 0:
                break
            scale = max(abs(p), 1.0)
            penalty = k * config.queue_penalty * scale + left / max(q, 1.0) * config.impact_penalty * scale
            move = mid - before if before and before > 0 else 0.0
            if move > 0 if side == "buy" else move < 0:
                penalty += abs(move / before) * config.adverse_penalty * scale
            p = p + penalty if side == "buy" else p - penalty
            if p > best * (1 + config.max_slippage) if side == "buy" else p < best * (1 - config.max_slippage):
                break
            take = min(left, q)
            value, filled, left = value + take * p, filled + take, left - take
        return (filled, value / filled) if filled > 0 else (0.0, 0.0)

    for i, (ts, bids, asks, signal) in enumerate(zip(rows["ts"], rows["bids"], rows["asks"], rows["signal"], strict=True)):
        bids = [(x["price"], x["size"]) for x in bids]
        asks = [(x["price"], x["size"]) for x in asks]
        mid = (bids[0][0] + asks[0][0]) / 2 if bids and asks else 0.0

        def execute(order: dict) -> None:
            nonlocal cash, size, entry
            levels = asks if order["side"] == "buy" else bids
            q, gross = fill(levels, levels[0][0] if levels else 0.0, order["side"], order["left"], mid)
            if q <= 0:
                return
            paid = config.costs.price(gross, order["side"], q)
            if order["side"] == "buy":
                cash -= paid * q
                size += q
                entry = None if size <= 0 else paid if entry is None else (entry * (size - q) + paid * q) / size
            else:
                cash += paid * q
                size -= q
                entry = None if size <= 0 else entry
            order["left"] -= q
            out.add("trade", ts=ts, side=order["side"], price=paid, size=q, cost=abs(paid - gross) * q)

        if pending and pending["ready"] <= i:
            execute(pending)
            if pending["left"] <= 0:
                pending = None
        if pending is None:
            new = None
            if size != 0 and signal == 0:
                new = {"side": "sell" if size > 0 else "buy", "left": abs(size), "ready": i}
            elif signal > 0 and size <= 0 or signal < 0 and size >= 0:
                new = {"side": "buy" if signal > 0 else "sell", "left": config.position_size, "ready": i + wait}
            if new and new["ready"] <= i:
                execute(new)
            elif new:
                pending = new
        before = mid
        out.add("equity", ts=ts, equity=cash + size * mid, cash=cash, position_size=size, avg_entry_price=entry)


Runner = Callable[[pd.DataFrame, object, _Rows], None]


def run_fold(rows: DataFrame, runner: Runner, variants: dict[str, object], by: list[str], order: list[str]) -> DataFrame:
    """Run every variant over every series; ``series`` joins the key columns by '|'.

    Variants multiply the rows before the exchange, so that they run in parallel.
    """
    keyed = rows.withColumns({"series": F.concat_ws("|", *by), "variant": F.explode(F.array(*map(F.lit, variants)))})

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = _Rows(*key)
        runner(frame.sort_values(order, kind="stable"), variants[key[1]], out)
        return out.frame()

    return keyed.groupBy("series", "variant").applyInPandas(run, FOLD)


def backtests(bars: DataFrame, variants: dict[str, BacktestConfig], by: list[str]) -> DataFrame:
    """``bars`` have a signal column and, for gated variants, the risk inputs. Variants without a gate need no fold."""
    free = {k: v for k, v in variants.items() if v.risk is None}
    gated = {k: v for k, v in variants.items() if v.risk is not None}
    if not gated:
        return ungated_backtests(bars, free, by)
    run = stream_backtests(bars, gated, by)
    return run.unionByName(ungated_backtests(bars, free, by)) if free else run


def ungated_backtests(bars: DataFrame, variants: dict[str, BacktestConfig], by: list[str]) -> DataFrame:
    """The rows of ``backtest_series`` for variants without a gate, by windows over one partitioning.

    Without a gate, positions follow from signals alone. Take runs of bars of one signal sign. A run of zeros leaves no
    position; one of two bars or more leaves its own; one of a single bar opens if nothing is open, and else only
    closes, so it turns the state over. Hence the state after a run is the parity of single-bar runs since the last
    other run. What each variant pays only changes prices, and equity is a running product of returns.
    """
    w = Window.partitionBy("series").orderBy("ts")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.select(F.concat_ws("|", *by).alias("series"), "ts", "close", F.coalesce(F.signum("signal"), F.lit(0.0)).cast("int").alias("a"))
    rows = rows.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("series"))}).where("n >= 2")
    rows = rows.withColumn("a", F.when(F.col("i") > 0, F.col("a")).otherwise(0))  # the first bar only starts the series
    before = F.lag("a").over(w)
    first = before.isNull() | (before != F.col("a"))
    twice = F.coalesce(F.lead("a").over(w) == F.col("a"), F.lit(False))
    rows = rows.withColumns({"first": first, "settles": F.when(first & (F.col("a") == 0), 0).when(first & twice, 1), "turns": (first & (F.col("a") != 0) & ~twice).cast("int")})
    rows = rows.withColumn("turned", F.sum("turns").over(up_to))
    since = F.col("turned") - F.last(F.when(F.col("settles").isNotNull(), F.col("turned")), ignorenulls=True).over(up_to)
    rows = rows.withColumn("after", (F.last("settles", ignorenulls=True).over(up_to) + since) % 2 == 1)  # bar 0 settles
    rows = rows.withColumn("hold", (F.col("a") != 0) & (~F.col("first") | ~F.coalesce(F.lag("after").over(w), F.lit(False))))
    held, last = F.coalesce(F.lag("hold").over(w), F.lit(False)), F.col("i") == F.col("n") - 1
    rows = rows.withColumns({"leave": held & (last | F.col("first")), "enter": ~held & (F.col("a") != 0), "side": F.coalesce(F.lag("a").over(w), F.lit(0))})
    rows = rows.withColumns({"entry_close": F.last(F.when(F.col("enter"), F.col("close")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "nth_leave": F.sum(F.col("leave").cast("int")).over(up_to) - 1, "nth_enter": F.sum(F.col("enter").cast("int")).over(up_to) - 1})

    terms = [(name, c.initial_equity, c.costs.taker_fee / 100.0 if c.costs else 0.0, c.costs.fx_spread_bps / 10000.0 if c.costs else 0.0) for name, c in variants.items()]
    term = F.inline(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("variant", "start", "fee", "fx"), t, strict=True))) for t in terms)))
    rows = rows.select("*", term)
    paid = lambda price, sign: (price + sign * price * F.col("fee")) * (1 + sign * F.col("fx"))
    rows = rows.withColumns({"entry_price": F.when(F.col("leave"), paid(F.col("entry_close"), F.col("side"))), "exit_price": F.when(F.col("leave"), paid(F.col("close"), -F.col("side")))})
    rows = rows.withColumn("return_pct", F.col("side") * (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price"))
    run = Window.partitionBy("series", "variant").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("equity", F.col("start") * F.product(1.0 + F.coalesce("return_pct", F.lit(0.0))).over(run))
    cost = F.abs(F.col("exit_price") - F.col("close")) + F.abs(F.col("entry_price") - F.col("close"))
    kinds = {c.split()[0]: c.split()[1] for c in FOLD.split(", ")}

    def row(**values):
        return F.struct(*((values[n] if n in values else F.lit(None)).cast(k).alias(n) for n, k in kinds.items() if n not in ("series", "variant")))

    word = lambda c, plus, minus: F.when(c > 0, plus).otherwise(minus)
    equity = row(kind=F.lit("equity"), seq=F.col("i"), ts=F.col("ts"), equity=F.col("equity"))
    trade = row(kind=F.lit("trade"), seq=F.col("nth_leave"), ts=F.col("ts"), side=word(F.col("side"), "long", "short"), entry_price=F.col("entry_price"), exit_price=F.col("exit_price"), size=F.lit(1.0), return_pct=F.col("return_pct"), equity=F.col("equity"), cost=cost)
    decision = row(kind=F.lit("decision"), seq=F.col("nth_enter"), ts=F.col("ts"), side=word(F.col("a"), "buy", "sell"), allowed=F.lit(True), size=F.lit(1.0), price=F.col("close"))
    tagged = F.array_compact(F.array(equity, F.when(F.col("leave"), trade), F.when(F.col("enter"), decision)))
    return rows.select("series", "variant", F.inline(tagged)).select(*kinds)


def paper_runs(bars: DataFrame, variants: dict[str, PaperConfig], by: list[str]) -> DataFrame:
    return run_fold(bars, paper_series, variants, by, ["ts"])


def simulations(books: DataFrame, variants: dict[str, SimulatorConfig], by: list[str]) -> DataFrame:
    return run_fold(books, simulate_series, variants, by, ["ts"])


def account_state(fills: DataFrame, by: list[str], order: list[str], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Balances and positions after a venue's fills: sells floor the position at 0, so it is a reflected sum.

    With s the running sum of signed sizes, the floored position is ``s - min(0, min s)``; no fold is needed, and a hot
    account is scanned in chunks.
    """
    signed = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))
    flow = F.when(F.col("side") == "buy", -(F.col("price") * F.col("size") + F.col("fee"))).otherwise(F.col("price") * F.col("size") - F.col("fee"))
    rows = with_running(fills, by, order, {"s": ("sum", signed), "low": ("low", signed), "balance_change": ("sum", flow)}, split_rows)
    return rows.withColumn("position", reflected(F.col("s"), F.col("low"))).drop("s", "low")
