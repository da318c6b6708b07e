"""Schemas of the market tables, as DDL."""

from __future__ import annotations

TICK = "id long, exchange string, symbol string, ts timestamp, bid double, ask double, last double, volume double, raw string"
BAR = "exchange string, symbol string, interval_seconds int, ts timestamp, open double, high double, low double, close double, volume double"
LEVELS = "array<struct<price: double, size: double>>"
BOOK = f"exchange string, symbol string, ts timestamp, bids {LEVELS}, asks {LEVELS}"
TRADE = "id long, ts timestamp, source string, exchange string, pair string, side string, price double, size double, fee double, role_maker_taker string, latency_ms long"
EQUITY = "id long, ts timestamp, source string, equity double, cash double, position_size double"
EVENT = "id long, ts timestamp, level string, event_type string, message string, source string, metadata string"
FX_RATE = "id long, pair string, rate double, fetched_at timestamp"
DAILY_SUMMARY = "report_date date, created_at timestamp, total_trades long, starting_equity double, ending_equity double, total_pnl double, max_drawdown double, max_drawdown_pct double, alert_count long, runtime_status string, research_status string, summary_text string"
#: One schema for all outputs of a fold; ``kind`` tells equity, trade, order and decision rows apart.
FOLD = "series string, variant string, kind string, seq long, ts timestamp, order_id string, side string, status string, price double, entry_price double, exit_price double, size double, filled_size double, return_pct double, equity double, cash double, position_size double, avg_entry_price double, unrealized_pnl double, realized_pnl double, fees double, cost double, allowed boolean, reason string"
