"""The entry gate: an ordered chain of limits, then sizing. One form for columns, a twin for folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits by venue, fixed values.
VENUE_CAPS = {
    "kraken": {"max_position_size": 0.5, "max_notional_per_trade": 500.0, "max_total_notional": 2500.0, "max_open_positions": 1, "max_open_orders": 2},
    "firi": {"max_position_size": 0.35, "max_notional_per_trade": 400.0, "max_total_notional": 2000.0, "max_open_positions": 1, "max_open_orders": 2},
    "sandbox": {"max_position_size": 1.0, "max_notional_per_trade": 1000.0, "max_total_notional": 5000.0, "max_open_positions": 3, "max_open_orders": 5},
}
DEFAULT_OPEN_ORDERS = 5


@dataclass(frozen=True)
class RiskConfig:
    max_drawdown_pct: float = 0.25
    max_volatility_pct: float = 0.10
    risk_per_trade_pct: float = 0.02
    max_position_size: float = 1.0
    volatility_window: int = 10
    kelly_fraction: float = 0.5
    kelly_window: int = 20
    max_slippage_pct: float = 0.03
    max_spread_pct: float = 0.03
    max_quote_age_seconds: int = 900
    inventory_skew_threshold: float = 0.5
    inventory_penalty_factor: float = 0.5
    max_notional_per_trade: float = 1000.0
    max_total_notional: float = 5000.0
    max_open_positions: int = 3
    enforce_quote_freshness: bool = False
    hard_stop_drawdown_pct: float = 0.02
    venue_caps: dict = field(default_factory=dict)
    paper_mode: bool = False

    def caps(self, exchange: str | None) -> dict:
        """A venue's limits: configured ones replace the defaults wholesale."""
        name = (exchange or "").strip().lower()
        return (self.venue_caps.get(name) or VENUE_CAPS.get(name, {})) if name else {}

    def resolved(self, exchange: str | None) -> dict:
        c = self.caps(exchange)
        return {
            "max_position_size": max(0.0, float(c.get("max_position_size", self.max_position_size))),
            "max_notional_per_trade": max(0.0, float(c.get("max_notional_per_trade", self.max_notional_per_trade))),
            "max_total_notional": max(0.0, float(c.get("max_total_notional", self.max_total_notional))),
            "max_open_positions": int(c.get("max_open_positions", self.max_open_positions)),
            "max_open_orders": int(c.get("max_open_orders", DEFAULT_OPEN_ORDERS)),
        }


# --- columns


def with_caps(rows: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """Add the venue's limits. The dimension has a row for each configured venue, a bound that the config sets."""
    venues = sorted({*VENUE_CAPS, *config.venue_caps})
    limits = [(v, *config.resolved(v).values()) for v in venues]
    names = list(config.resolved(None))
    spark = rows.sparkSession
    ddl = "venue string, cap_max_position_size double, cap_max_notional_per_trade double, cap_max_total_notional double, cap_max_open_positions int, cap_max_open_orders int"
    base = config.resolved(None)
    joined = rows.withColumn("venue", F.lower(F.trim("exchange"))).join(F.broadcast(spark.createDataFrame(limits, ddl)), "venue", "left").drop("venue")
    return joined.withColumns({f"cap_{n}": F.coalesce(f"cap_{n}", F.lit(base[n])) for n in names})


def decide(rows: DataFrame, config: RiskConfig = RiskConfig(), rules: Sequence[tuple[Column, str]] = (), sizing: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add allowed, position_size and reason.

    ``rules``: further (condition, reason), asked in turn after the limits here; a null condition doesn't block. ``sizing``
    makes the size of what is allowed from the gate's own; what it gives is kept between 0 and the venue's limit, and null
    is 0. Both are column expressions over all columns of ``rows`` and the venue's limits (``cap_...``).

    ``rows`` have the gate's inputs: exchange; slippage_pct, spread_pct, stale, volatility_pct and kelly of the bar;
    equity, peak_equity, position, open_positions, venue_open_positions, open_orders, venue_notional, inventory_skew;
    signal_side; hard_stop and breaker flags.
    """
    c = F.col
    cfg = config
    down = F.when(c("peak_equity") > 0, F.greatest(F.lit(0.0), (c("peak_equity") - c("equity")) / c("peak_equity"))).otherwise(0.0)
    live = F.lit(not cfg.paper_mode)
    chain = [
        (c("hard_stop"), "hard_stop"),
        (c("breaker"), "circuit_breaker"),
        (c("position") != 0, "position_open"),
        (live & (c("slippage_pct") > cfg.max_slippage_pct), "slippage_limit"),
        (live & (c("spread_pct") > cfg.max_spread_pct), "spread_limit"),
        (live & F.lit(cfg.enforce_quote_freshness) & c("stale"), "stale_quote"),
        (down > cfg.max_drawdown_pct, "drawdown_limit"),
        (down > cfg.hard_stop_drawdown_pct, "hard_stop_drawdown"),
        (c("open_positions") >= cfg.max_open_positions, "position_limit"),
        (c("venue_open_positions") >= c("cap_max_open_positions"), "exchange_position_limit"),
        (c("open_orders") >= c("cap_max_open_orders"), "open_order_limit"),
        ((c("cap_max_total_notional") > 0) & (c("venue_notional") >= c("cap_max_total_notional")), "exchange_notional_limit"),
        (live & (c("volatility_pct") > cfg.max_volatility_pct), "volatility_limit"),
        *rules,
    ]
    size = position_size(cfg)
    if sizing:
        size = F.greatest(F.lit(0.0), F.least(c("cap_max_position_size"), F.coalesce(sizing(size), F.lit(0.0))))
    reason = F.when(chain[0][0], chain[0][1])
    for condition, name in chain[1:]:
        reason = reason.when(condition, name)
    limited = with_caps(rows, cfg).withColumn("reason", reason)
    return limited.withColumns({"allowed": c("reason").isNull(), "position_size": F.when(c("reason").isNotNull(), 0.0).otherwise(size)})


def position_size(config: RiskConfig) -> Column:
    """Volatility target by Kelly, less the inventory penalty, within the venue's limits."""
    c = F.col
    limit = c("cap_max_position_size")
    base = F.when(c("volatility_pct") <= 0, limit).otherwise(F.least(limit, F.try_divide(F.lit(config.risk_per_trade_pct), c("volatility_pct"))) * c("kelly"))
    over = (F.greatest(F.lit(0.0), c("inventory_skew")) - config.inventory_skew_threshold) / max(1e-9, 1.0 - config.inventory_skew_threshold)
    penalty = F.least(F.lit(1.0), over * config.inventory_penalty_factor)
    penalised = F.when(base <= 0, 0.0).when((c("signal_side") == "buy") & (over > 0), F.greatest(F.lit(0.0), base * (1.0 - penalty))).otherwise(base)
    trade, total, used = c("cap_max_notional_per_trade"), c("cap_max_total_notional"), c("venue_notional")
    room = F.greatest(F.lit(0.0), total - used)
    capped = (
        F.when(penalised <= 0, 0.0)
        .when(used + trade <= 0, penalised)
        .when((trade > 0) & (used > trade), 0.0)
        .when((total > 0) & (room <= 0), 0.0)
        .when(total > 0, F.greatest(F.lit(0.0), F.least(penalised, room / F.greatest(F.lit(1.0), c("equity")))))
        .when(F.abs("position") >= limit, 0.0)
        .otherwise(penalised)
    )
    return F.greatest(F.lit(0.0), F.least(limit, capped))


def order_size(requested: Column, risk_size: Column, cash: Column, equity: Column, price: Column, risk_pct: float = 0.0) -> Column:
    """What an entry may order: the least of request, risk size, cash and, with a risk share, equity at risk."""
    at_risk = [equity * risk_pct / price] if risk_pct > 0 else []
    return F.when((price > 0) & (cash > 0), F.greatest(F.lit(0.0), F.least(requested, risk_size, cash / price, *at_risk))).otherwise(0.0)


# --- the twin for folds


@dataclass
class Gate:
    """The same chain on plain numbers; a breaker latches when a drawdown trips it."""

    config: RiskConfig
    exchange: str | None = None
    use_breaker: bool = False
    breaker: bool = False

    def __post_init__(self) -> None:
        self.caps = self.config.resolved(self.exchange)

    def evaluate(self, *, slippage: float, spread: float, stale: bool, volatility: float, kelly: float, equity: float, peak: float, side: str | None = None, position: float = 0.0, open_positions: int = 0, open_orders: int = 0, notional: float = 0.0, skew: float = 0.0, hard_stop: bool = False) -> tuple[bool, float, str | None]:
        cfg, caps = self.config, self.caps
        down = max(0.0, (peak - equity) / peak) if peak > 0 else 0.0
        reason = None
        if hard_stop:
            reason = "hard_stop"
        elif self.breaker:
            reason = "circuit_breaker"
        elif position != 0.0:
            reason = "position_open"
        elif not cfg.paper_mode and slippage > cfg.max_slippage_pct:
            reason = "slippage_limit"
        elif not cfg.paper_mode and spread > cfg.max_spread_pct:
            reason = "spread_limit"
        elif not cfg.paper_mode and cfg.enforce_quote_freshness and stale:
            reason = "stale_quote"
        elif down > cfg.max_drawdown_pct:
            reason = "drawdown_limit"
        elif down > cfg.hard_stop_drawdown_pct:
            reason = "hard_stop_drawdown"
            self.breaker = self.use_breaker
        elif open_positions >= cfg.max_open_positions:
            reason = "position_limit"
        elif open_positions >= caps["max_open_positions"]:
            reason = "exchange_position_limit"
        elif open_orders >= caps["max_open_orders"]:
            reason = "open_order_limit"
        elif caps["max_total_notional"] > 0 and notional >= caps["max_total_notional"]:
            reason = "exchange_notional_limit"
        elif not cfg.paper_mode and volatility > cfg.max_volatility_pct:
            reason = "volatility_limit"
        if reason:
            return False, 0.0, reason
        return True, self._size(volatility, kelly, side, skew, notional, equity, position), None

    def _size(self, volatility: float, kelly: float, side: str | None, skew: float, notional: float, equity: float, position: float) -> float:
        cfg, caps = self.config, self.caps
        limit = caps["max_position_size"]
        size = limit if volatility <= 0 else min(limit, cfg.risk_per_trade_pct / volatility) * kelly
        over = (max(0.0, skew) - cfg.inventory_skew_threshold) / max(1e-9, 1.0 - cfg.inventory_skew_threshold)
        if size > 0 and side == "buy" and over > 0:
            size = max(0.0, size * (1.0 - min(1.0, over * cfg.inventory_penalty_factor)))
        trade, total = caps["max_notional_per_trade"], caps["max_total_notional"]
        if size <= 0:
            return 0.0
        if notional + trade > 0:
            if trade > 0 and notional > trade:
                size = 0.0
            elif total > 0:
                size = min(size, max(0.0, total - notional) / max(1.0, equity))
            elif abs(position) >= limit:
                size = 0.0
        return max(0.0, min(limit, size))
