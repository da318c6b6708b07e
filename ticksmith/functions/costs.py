"""Trading costs, as columns and, for folds, as plain functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maker and taker fees in per cent by venue, and the FX spread of all: fixed values.
FEES = {"kraken": (0.25, 0.40), "firi": (0.10, 0.20)}
FX_SPREAD_BPS = 10.0


@dataclass(frozen=True)
class CostModel:
    maker_fee: float = 0.0
    taker_fee: float = 0.0
    fx_spread_bps: float = FX_SPREAD_BPS

    @classmethod
    def of(cls, exchange: str) -> CostModel:
        return cls(*FEES.get(exchange.lower(), (0.0, 0.0)))

    def price(self, price: float, side: str, size: float = 1.0, role: str = "taker") -> float:
        """The unit price with fee and FX spread. The fee is on price times size, yet per unit, as the model has it."""
        sign = -1.0 if side in ("sell", "short") else 1.0
        fee = (self.maker_fee if role == "maker" else self.taker_fee) / 100.0
        return (price + sign * price * fee * size) * (1 + sign * self.fx_spread_bps / 10000.0)


def fee_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in FEES.items()], "exchange string, maker_fee double, taker_fee double")


def trade_cost(price: Column, fee_pct: Column, side: Column, size: Column) -> Column:
    sign = F.when(F.lower(side).isin("sell", "short"), -1.0).otherwise(1.0)
    return price + sign * price * (fee_pct / 100.0) * size


def fx_cost(price: Column, side: Column, size: Column, bps: Column | float = FX_SPREAD_BPS) -> Column:
    sign = F.when(F.lower(side).isin("sell", "short"), -1.0).otherwise(1.0)
    return price * (1 + sign * (F.lit(bps) if isinstance(bps, float) else bps) / 10000.0) * size


def with_effective_price(trades: DataFrame, role: str = "taker") -> DataFrame:
    """Add ``effective_price`` by each row's venue; the fee table has a row a venue and is broadcast."""
    fee = F.coalesce(F.col(f"{role}_fee"), F.lit(0.0))
    joined = trades.withColumn("venue", F.lower("exchange")).join(F.broadcast(fee_table(trades.sparkSession).withColumnRenamed("exchange", "venue")), "venue", "left")
    return joined.withColumn("effective_price", fx_cost(trade_cost(F.col("price"), fee, F.col("side"), F.col("size")), F.col("side"), F.lit(1.0))).drop("venue", "maker_fee", "taker_fee")
