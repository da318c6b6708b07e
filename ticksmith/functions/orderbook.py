"""Order books as arrays of (price, size): folds over the top levels, all column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _sum(levels: Column, value) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda acc, x: acc + value(x))


def depth_volume(levels: Column, depth: int) -> Column:
    return _sum(F.slice(levels, 1, depth), lambda x: x["size"])


def _checked(bids: Column, asks: Column, value: Column) -> Column:
    """An empty side is an error."""
    return F.when((F.size(bids) > 0) & (F.size(asks) > 0), value).otherwise(F.raise_error(F.lit("an order book needs bids and asks")))


def mid_price(bids: Column, asks: Column) -> Column:
    """Mean of the best prices, 0 if a side is empty."""
    return F.when((F.size(bids) > 0) & (F.size(asks) > 0), (F.get(bids, 0)["price"] + F.get(asks, 0)["price"]) / 2).otherwise(0.0)


def imbalance(bids: Column, asks: Column, depth: int = 5) -> Column:
    """(bid volume - ask volume) / both, 0 without volume; also known as volume delta."""
    b, a = depth_volume(bids, depth), depth_volume(asks, depth)
    return _checked(bids, asks, F.when(a + b > 0, (b - a) / (a + b)).otherwise(0.0))


volume_delta = imbalance


def micro_price(bids: Column, asks: Column, depth: int = 5) -> Column:
    """Best prices weighted by the other side's volume over the top levels; the mid without volume."""
    b, a = depth_volume(bids, depth), depth_volume(asks, depth)
    best_bid, best_ask = F.get(bids, 0)["price"], F.get(asks, 0)["price"]
    return _checked(bids, asks, F.when(a + b > 0, (best_bid * a + best_ask * b) / (a + b)).otherwise((best_bid + best_ask) / 2))


def with_metrics(books: DataFrame, depth: int = 5) -> DataFrame:
    """Add mid, spread, micro price, volumes, depth VWAP and imbalance, at 10 places."""
    bids, asks = F.col("bids"), F.col("asks")
    b, a = depth_volume(bids, depth), depth_volume(asks, depth)
    worth = _sum(F.slice(bids, 1, depth), lambda x: x["price"] * x["size"]) + _sum(F.slice(asks, 1, depth), lambda x: x["price"] * x["size"])
    vwap = F.when(a + b > 0, worth / (a + b)).otherwise(mid_price(bids, asks))
    named = {
        "mid_price": mid_price(bids, asks),
        "spread": F.get(asks, 0)["price"] - F.get(bids, 0)["price"],
        "micro_price": micro_price(bids, asks, depth),
        "bid_volume": b,
        "ask_volume": a,
        "vwap": vwap,
        "imbalance": imbalance(bids, asks, depth),
    }
    return books.withColumns({k: F.round(v, 10) for k, v in named.items()})


def mid_signal(bids: Column, asks: Column, window: WindowSpec) -> Column:
    """First 0, then 1 if the mid has risen and else -1."""
    mid = F.round(mid_price(bids, asks), 10)
    before = F.lag(mid).over(window)
    return F.when(before.isNull(), 0.0).when(mid > before, 1.0).otherwise(-1.0)


# --- depth fills


def adjusted_price(price: Column, side: str, level: Column, remaining: Column, volume: Column, mid: Column, previous_mid: Column, queue: float, impact: float, adverse: float) -> Column:
    """A level's price with penalties for queue place, impact and an adverse move of the mid."""
    scale = F.greatest(F.abs(price), F.lit(1.0))
    penalty = level * queue * scale + remaining / F.greatest(volume, F.lit(1.0)) * impact * scale
    move = mid - previous_mid
    against = move > 0 if side == "buy" else move < 0
    penalty = penalty + F.when((previous_mid > 0) & against, F.abs(F.try_divide(move, previous_mid)) * adverse * scale).otherwise(0.0)
    return price + penalty if side == "buy" else price - penalty


def depth_fill(bids: Column, asks: Column, side: str, size: Column, previous_mid: Column, max_slippage: float = 0.01, queue: float = 0.0, impact: float = 0.0, adverse: float = 0.0) -> Column:
    """(filled, price): walk the levels until the size is filled or a price leaves the band around the best one."""
    levels = asks if side == "buy" else bids
    best = F.get(levels, 0)["price"]
    mid = mid_price(bids, asks)
    start = F.struct(size.cast("double").alias("remaining"), F.lit(0.0).alias("value"), F.lit(0.0).alias("filled"), F.lit(False).alias("stop"), F.lit(0).alias("level"))

    def step(acc: Column, x: Column) -> Column:
        price = adjusted_price(x["price"], side, acc["level"], acc["remaining"], x["size"], mid, previous_mid, queue, impact, adverse)
        inside = price <= best * (1 + max_slippage) if side == "buy" else price >= best * (1 - max_slippage)
        stop = acc["stop"] | (acc["remaining"] <= 0) | ~inside
        q = F.when(stop, 0.0).otherwise(F.least(acc["remaining"], x["size"]))
        return F.struct((acc["remaining"] - q).alias("remaining"), (acc["value"] + q * price).alias("value"), (acc["filled"] + q).alias("filled"), stop.alias("stop"), (acc["level"] + 1).alias("level"))

    return F.aggregate(levels, start, step, lambda acc: F.struct(acc["filled"].alias("filled"), F.when(acc["filled"] > 0, acc["value"] / acc["filled"]).otherwise(0.0).alias("price")))
