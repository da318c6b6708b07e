"""Market time-series analytics on Spark: bars, indicators, order books, risk, backtests, reports and reconciliation."""
