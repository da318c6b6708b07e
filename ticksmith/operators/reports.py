"""Daily and operational reports over trades, equity snapshots and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticksmith.operators.scans import SPLIT_ROWS, with_running

DECISION = "allowed boolean, reason string, status string"


def daily_summary(trades: DataFrame, equity: DataFrame, events: DataFrame, default_equity: float = 1000.0) -> DataFrame:
    """All days at once: trades, equity before and at the end of the day, range drawdown and alerts.

    A day starts from the last snapshot strictly before its first; the first day starts from ``default_equity``. The
    running frame is over days, of which there are few, not over snapshots.
    """
    order = F.struct("ts", "id")
    t = trades.groupBy(F.to_date("ts").alias("report_date")).agg(F.count("*").alias("total_trades"))
    a = events.where("event_type = 'runtime_alert'").groupBy(F.to_date("ts").alias("report_date")).agg(F.count("*").alias("alert_count"))
    e = equity.groupBy(F.to_date("ts").alias("report_date")).agg(F.max_by("equity", order).alias("ending_equity"), F.max("equity").alias("peak"), F.min("equity").alias("trough"))
    e = e.withColumn("starting_equity", F.coalesce(F.lag("ending_equity").over(Window.orderBy("report_date")), F.lit(default_equity)))
    out = e.join(t, "report_date", "full_outer").join(a, "report_date", "full_outer")
    start, end = F.coalesce("starting_equity", F.lit(default_equity)), F.coalesce("ending_equity", F.lit(default_equity))
    down = F.coalesce(F.greatest(F.lit(0.0), F.col("peak") - F.col("trough")), F.lit(0.0))
    return out.select(
        "report_date", F.coalesce("total_trades", F.lit(0)).alias("total_trades"), start.alias("starting_equity"), end.alias("ending_equity"), (end - start).alias("total_pnl"),
        down.alias("max_drawdown"), F.when(F.col("peak") > 0, down / F.col("peak")).otherwise(0.0).alias("max_drawdown_pct"), F.coalesce("alert_count", F.lit(0)).alias("alert_count"),
    )


def summary_text() -> Column:
    """The line that a daily report prints."""
    return F.format_string("date=%s trades=%d pnl=%.4f drawdown=%.4f alerts=%d", F.col("report_date").cast("string"), "total_trades", "total_pnl", "max_drawdown", "alert_count")


def decisions(events: DataFrame, more: list[str] = []) -> DataFrame:
    """Entry decisions and order events with their parsed metadata and columns ``more``; bad metadata has null fields."""
    kept = ["id", "ts", "source", "event_type"]
    return events.where(F.col("event_type").isin("entry_decision", "order_lifecycle")).withColumn("meta", F.from_json("metadata", DECISION)).select(*kept, *(c for c in more if c not in kept), F.coalesce("meta.allowed", F.lit(False)).alias("allowed"), F.coalesce("meta.reason", F.lit("unknown")).alias("reason"), F.col("meta.status").alias("status"))


def reason_counts(events: DataFrame) -> DataFrame:
    """How often each reason blocked an entry or cancelled an order."""
    d = decisions(events)
    kept = d.where("(event_type = 'entry_decision' AND NOT allowed) OR (event_type = 'order_lifecycle' AND status = 'CANCELED')")
    return kept.groupBy("event_type", "reason").agg(F.count("*").alias("n"))


def ranked_reasons(counts: DataFrame) -> DataFrame:
    """``reason_counts`` with each reason's place among those of its event type: most often first, then by name.

    A row a reason, so the windows are small however long the log is.
    """
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "reason")))


def risk_stops(events: DataFrame, by: list[str], cycle: str) -> DataFrame:
    """States of the risk-stop alert: active in a cycle that blocked an entry, with how many and why."""
    d = decisions(events, [*by, cycle]).where("event_type = 'entry_decision'")
    return d.groupBy(*by, cycle).agg(F.count_if(~F.col("allowed")).alias("blocked"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("allowed"), F.col("reason")))), ",").alias("reasons")).withColumn("active", F.col("blocked") > 0)


def reconciliation_alert(summary: DataFrame) -> DataFrame:
    """The state of the reconciliation alert, from ``account_summary``."""
    n = F.col("mismatched_orders") + F.col("mismatched_balances")
    return summary.select((F.col("status") != "matched").alias("active"), n.alias("mismatches"), F.format_string("reconciliation mismatch detected (status=%s, mismatches=%d)", "status", n).alias("message"))


def new_trades(counts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Trades that each cycle has more than the one before: ``counts`` have a total n a cycle; a smaller total is a new run."""
    before = F.coalesce(F.lag("n").over(Window.partitionBy(*by).orderBy(*order)), F.lit(0))
    return counts.withColumn("new", F.when(F.col("n") >= before, F.col("n") - before).otherwise(F.col("n")))


def decision_summary(events: DataFrame, by: list[str]) -> DataFrame:
    """Decisions allowed and blocked, with the blocked reasons' counts as a map."""
    d = decisions(events).where("event_type = 'entry_decision'")
    per = d.groupBy(*by, "reason").agg(F.count("*").alias("n"), F.count_if("allowed").alias("ok"))
    pairs = F.collect_list(F.when(F.col("n") > F.col("ok"), F.struct("reason", (F.col("n") - F.col("ok")).alias("n"))))
    return per.groupBy(*by).agg(F.sum("n").alias("total"), F.sum("ok").alias("allowed"), (F.sum("n") - F.sum("ok")).alias("blocked"), F.map_from_entries(F.array_sort(pairs)).alias("reasons"))


def no_trade_reason(events: DataFrame, by: list[str]) -> DataFrame:
    """The most frequent blocked reason; of equals the one that came first."""
    d = decisions(events).where("event_type = 'entry_decision' AND NOT allowed")
    per = d.groupBy(*by, "reason").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return per.groupBy(*by).agg(F.max_by(F.struct("reason", "n"), F.struct("n", -F.col("first"))).alias("top")).select(*by, F.col("top.reason").alias("reason"), F.col("top.n").alias("n"))


def upsert_latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last written row of each key: what an upsert leaves. One hash aggregation, combined on the map side."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def alert_edges(states: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows where an alert starts or clears: it is raised once until it is cleared."""
    before = F.coalesce(F.lag("active").over(Window.partitionBy(*by).orderBy(*order)), F.lit(False))
    return states.withColumn("edge", F.when(F.col("active") & ~before, "raised").when(~F.col("active") & before, "cleared")).where("edge IS NOT NULL")


def stale_feeds(bars: DataFrame, by: list[str], now: Column, interval_seconds: float = 1.0, bar_seconds: int = 60) -> DataFrame:
    """Feeds whose newest bar is older than max(30, 10 intervals, 3 bars) seconds; ``now`` is given, so tests can fix it."""
    limit = max(30.0, 10.0 * interval_seconds, 3.0 * bar_seconds)
    newest = bars.groupBy(*by).agg(F.max("ts").alias("newest"))
    age = (F.unix_micros(now) - F.unix_micros("newest")) / 1e6
    return newest.withColumns({"age_seconds": age, "stale": age > limit})


def stale_edges(ticks: DataFrame, by: list[str], limit_seconds: float, now: Column, forget_seconds: float = 86400.0, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(by, at, edge): when each feed turned stale, and the ticks that ended it; ``now`` closes the last ticks.

    A feed is stale once its last tick is more than ``limit_seconds`` old; a tick after ``forget_seconds`` more clears
    nothing. Each tick is compared with the one before it, in chunks where a feed is hot.
    """
    limit, forget = int(limit_seconds * 1_000_000), int(forget_seconds * 1_000_000)
    rows = ticks.select(*by, "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
    gaps = with_running(rows, by, ["ts"], {"_last": ("last_before", F.col("_at"))}, split_rows).select(*by, "_at", "_last")
    ends = rows.groupBy(*by).agg(F.max("_at").alias("_last")).select(*by, F.lit(None).cast("long").alias("_at"), "_last")
    after = F.coalesce(F.col("_at"), F.unix_micros(now.cast("timestamp")))
    gap = gaps.unionByName(ends).where(after - F.col("_last") > limit)
    edge = lambda at, name: F.struct(F.timestamp_micros(at).alias("at"), F.lit(name).alias("edge"))
    cleared = F.when(F.col("_at") - F.col("_last") <= limit + forget, edge(F.col("_at"), "cleared"))
    found = gap.select(*by, F.explode(F.array(edge(F.col("_last") + limit, "raised"), cleared)).alias("e"))
    return found.where("e IS NOT NULL").select(*by, "e.at", "e.edge")
