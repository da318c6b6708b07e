"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of signals, sides, statuses and venue codes.
LONG_WORDS = ["buy", "long", "1", "true", "enter"]
SHORT_WORDS = ["sell", "short", "-1", "false", "exit"]
TERMINAL = ["FILLED", "CANCELED", "REJECTED", "NOT_FOUND"]
PAIR_CODES = {"BTC/EUR": "XXBTZEUR", "BTC/USD": "XXBTZUSD", "ETH/EUR": "XETHZEUR", "ETH/USD": "XETHZUSD"}


def bucket_start(ts: Column, seconds: int | Column) -> Column:
    """The start of the epoch-aligned bucket; a zoned time is converted, not relabelled."""
    width = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / width) * width)


def normalize_symbol(symbol: Column) -> Column:
    return F.replace(F.upper(symbol), F.lit("/"), F.lit(""))


def venue_pair(symbol: Column, codes: dict[str, str] = PAIR_CODES) -> Column:
    """The venue's code of a pair; others lose their slash."""
    pairs = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, symbol), normalize_symbol(symbol))


def normalize_signal(signal: Column) -> Column:
    """Text or number to a signed number; null and unknown words are 0."""
    text = F.lower(F.trim(signal.cast("string")))
    number = text.try_cast("double")
    return F.when(signal.isNull(), 0.0).when(text.isin(LONG_WORDS), 1.0).when(text.isin(SHORT_WORDS), -1.0).otherwise(F.coalesce(number, F.lit(0.0)))


def normalize_side(side: Column) -> Column:
    text = F.lower(F.trim(side))
    return F.when(text.isin("buy", "long"), "buy").when(text.isin("sell", "short"), "sell").otherwise(F.raise_error(F.concat(F.lit("unknown side: "), F.coalesce(side, F.lit("null")))))


def normalize_status(status: Column) -> Column:
    """A venue's order status as one of ours."""
    text = F.lower(F.trim(status))
    return (
        F.when(text.isin("filled", "closed", "complete", "completed"), "FILLED")
        .when(text.isin("partially_filled", "partially-filled", "partial"), "PARTIALLY_FILLED")
        .when(text.isin("canceled", "cancelled", "cancel"), "CANCELED")
        .when(text.isin("open", "pending", "submitted", "active"), "OPEN")
        .otherwise("SUBMITTED")
    )


def venue_status(status: Column) -> Column:
    """The order states of a venue that knows closed, open, pending and canceled; all others count as sent."""
    text = F.upper(F.trim(status))
    return F.when(text == "CLOSED", "FILLED").when(text.isin("OPEN", "PENDING"), "OPEN").when(text == "CANCELED", "CANCELED").otherwise("SUBMITTED")


def coerce_float(value: Column) -> Column:
    """A number or numeric text as a double, else null."""
    return value.cast("string").try_cast("double")


def numeric_entries(values: Column) -> Column:
    """A map's entries whose values are numbers."""
    return F.map_filter(F.transform_values(values, lambda k, v: v.cast("string").try_cast("double")), lambda k, v: v.isNotNull())


def first_nonzero(*values: Column) -> Column:
    """The first value that is neither null nor zero, else 0."""
    return F.coalesce(*(F.nullif(v, F.lit(0.0)) for v in values), F.lit(0.0))


def parse_timestamp(text: Column) -> Column:
    """ISO text as a timestamp; without a zone it is UTC whatever the session's zone is, bad text is null."""
    zoned = text.rlike(r"([Zz]|[+-]\d\d(:?\d\d)?)\s*$") & text.rlike(r"\d:\d\d")
    return F.when(zoned, F.try_to_timestamp(text)).otherwise(F.try_to_timestamp(F.concat(F.when(text.rlike(r"\d:\d\d"), F.trim(text)).otherwise(F.concat(F.trim(text), F.lit(" 00:00:00"))), F.lit("Z"))))


def body_pct(open_: Column, close: Column) -> Column:
    """Slippage estimate of a bar: abs(close - open) / close, 0 if close isn't positive."""
    return F.when(close > 0, F.abs(close - open_) / close).otherwise(0.0)


def range_pct(high: Column, low: Column, close: Column) -> Column:
    """Spread estimate of a bar: abs(high - low) / close, 0 if close isn't positive."""
    return F.when(close > 0, F.abs(high - low) / close).otherwise(0.0)


def utc_day(ts: Column) -> Column:
    """The UTC day of a timestamp, whatever the session's zone is."""
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")))


def since_day(ts: Column, day: str) -> Column:
    return utc_day(ts) >= F.to_date(F.lit(day))


def on_day(ts: Column, day: str) -> Column:
    return utc_day(ts) == F.to_date(F.lit(day))
