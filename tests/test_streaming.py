"""Each streamed result equals its batch form, over restarts, cut-off batches and repeated ones."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from ticksmith.operators import analytics, reports
from ticksmith.streaming import bars as stream
from ticksmith.streaming import daily, late, monitor, stale, tables

TICK = "id long, exchange string, symbol string, ts timestamp, bid double, ask double, last double, volume double"
DAY = dt.datetime(2024, 1, 1)


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def feed(spark, path, rows, ddl, numbers):
    """Write rows as one file a micro-batch, at times that rise, so that the source takes them in order."""
    for k, part in zip(numbers, rows, strict=True):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("overwrite").parquet(f"{path}/tmp{k}")
        import os
        import shutil

        found = next(f for f in os.listdir(f"{path}/tmp{k}") if f.startswith("part-") and f.endswith(".parquet"))
        os.makedirs(f"{path}/in", exist_ok=True)
        shutil.move(f"{path}/tmp{k}/{found}", f"{path}/in/{k:04d}.parquet")
        os.utime(f"{path}/in/{k:04d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))


def source(spark, path, ddl):
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def run(writer, checkpoint):
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return q


def test_a_silent_feed_raises_and_its_next_tick_clears(spark, tmp_path):
    """Ticks out of order within the delay, gaps over batches and within one, a feed that is forgotten, a restart."""
    path = str(tmp_path)
    rng = random.Random(4)
    times = {"a": sorted(rng.sample([*range(0, 300), *range(900, 1000), *range(3000, 3500)], 120)), "b": [5, 2000, 2005, 3400], "c": [10, 3490]}
    rows = sorted((t + rng.uniform(0, 50), s, t) for s, own in times.items() for t in own)
    ticks = [(k, "x", s, at(t), 1.0, 1.0, 1.0, 1.0) for k, (_, s, t) in enumerate(rows)]
    clock = [(10_000 + k, "x", "clock", at(t), 1.0, 1.0, 1.0, 1.0) for k, t in enumerate(range(0, 3700, 10))]
    both = sorted(ticks + clock, key=lambda r: rows[r[0]][0] if r[0] < 10_000 else (r[3] - DAY).total_seconds())
    batches = [both[k : k + 60] for k in range(0, len(both), 60)] + [[(99_999, "x", "clock", at(3691), 1.0, 1.0, 1.0, 1.0)]]
    feed(spark, path, batches[:5], TICK, range(5))
    write = lambda: stale.stale_edges(source(spark, path, TICK), 200, 2000, "1 minute").writeStream.format("parquet").option("path", f"{path}/out")
    run(write(), f"{path}/cp")
    first = spark.read.schema(stale.EDGES).parquet(f"{path}/out").count()
    feed(spark, path, batches[5:], TICK, range(5, len(batches)))
    run(write(), f"{path}/cp")
    got = spark.read.schema(stale.EDGES).parquet(f"{path}/out")
    # the watermark that the last batch but one left
    end = max(r[3] for b in batches[:-1] for r in b) - dt.timedelta(minutes=1)
    all_ = spark.createDataFrame([r for b in batches for r in b], TICK).where(F.col("ts") <= F.lit(end))
    want = reports.stale_edges(all_, ["exchange", "symbol"], 200, F.lit(end), 2000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert 0 < first < got.count() and {r.edge for r in got.collect()} == {"raised", "cleared"}
    assert [r.edge for r in got.where("symbol = 'c'").orderBy("at").collect()] == ["raised"]  # forgotten, so nothing is cleared


def test_sliding_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    path = str(tmp_path)
    rows = [[(k, "s" if k % 3 else "t", at(100 * k + (k % 7) * 30), float(k * k % 41)) for k in range(40 * b, 40 * b + 40)] for b in range(3)]
    ddl = "id long, source string, ts timestamp, equity double"
    feed(spark, path, rows[:2], ddl, range(2))
    write = lambda: analytics.window_pnl(source(spark, path, ddl).withWatermark("ts", "10 minutes"), ["source"], 3600, 900).writeStream.outputMode("append").format("parquet").option("path", f"{path}/out")
    run(write(), f"{path}/cp")
    feed(spark, path, rows[2:] + [[(999, "clock", at(40_000), 1.0)], [(1000, "clock", at(40_001), 1.0)]], ddl, range(2, 5))
    run(write(), f"{path}/cp")
    want = analytics.window_pnl(spark.createDataFrame([r for b in rows for r in b], ddl), ["source"], 3600, 900)
    got = spark.read.schema(want.schema).parquet(f"{path}/out").where("source != 'clock'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_ticks_are_kept_and_corrected(spark, tmp_path):
    """A batch is cut off before its ledger entry; then the stream goes on from its checkpoint."""
    path, rng = str(tmp_path), random.Random(6)
    batches = []
    for b in range(6):
        own = []
        for k in range(50):
            t = 120 * b + rng.randrange(120) - (rng.randrange(400) if rng.random() < 0.2 else 0)
            price = 100 + rng.random()
            own.append((50 * b + k, "x", rng.choice("AB"), at(max(0, t) + k / 100), price - 0.1, price + 0.1, price, 1.0))
        batches.append(own)
    feed(spark, path, batches, TICK, range(6))
    cut = {"left": 1}

    def take(rows, batch_id):
        if batch_id == 3 and cut["left"]:
            cut["left"] -= 1
            with pytest.MonkeyPatch.context() as m:
                m.setattr(tables, "commit", lambda *a: (_ for _ in ()).throw(OSError("cut off")))
                late.take_batch(rows, batch_id, f"{path}/t", 60, 90)
        late.take_batch(rows, batch_id, f"{path}/t", 60, 90)

    start = lambda: source(spark, path, TICK).writeStream.foreachBatch(take)
    with pytest.raises(Exception, match="cut off"):
        run(start(), f"{path}/cp")
    before = tables._committed(spark, f"{path}/t/bars")
    seen = spark.createDataFrame([r for b in batches[:3] for r in b], TICK)
    assert before == 2 and sorted(map(tuple, late.corrected_bars(spark, f"{path}/t", 60).collect())) == bars_of(seen)
    run(start(), f"{path}/cp")
    everything = spark.createDataFrame([r for b in batches for r in b], TICK)
    want = bars_of(everything)
    assert sorted(map(tuple, late.corrected_bars(spark, f"{path}/t", 60).collect())) == want
    kept = late.late_ticks(spark, f"{path}/t")
    assert kept.count() == kept.select("id").distinct().count() > 5
    streamed = {tuple(r) for r in late.streamed_bars(spark, f"{path}/t", 60).collect()}
    assert streamed != set(want)
    fixed = {tuple(r) for r in late.corrections(spark, f"{path}/t", 60).collect()}
    assert len(streamed) >= len(want) - 3 and set(want) - streamed == fixed


def bars_of(ticks):
    return sorted(tuple(r) for r in stream.stream_bars(ticks, 60).collect())


LOG = "kind string, ts timestamp, id long, equity double"


def test_the_daily_summary_of_a_stream_killed_between_write_and_commit(spark, tmp_path):
    path, rng = str(tmp_path), random.Random(9)
    rows = [(rng.choice(["trade", "equity", "alert"]), at(rng.randrange(5 * 86400)), k) for k in range(300)]
    rows = [(kind, t, k, float(rng.randrange(900, 1100)) if kind == "equity" else None) for kind, t, k in rows]
    feed(spark, path, [rows[k : k + 60] for k in range(0, 300, 60)], LOG, range(5))
    cut = {"left": 2}

    def take(part, batch_id):
        if batch_id in (1, 3) and cut["left"] and cut["left"] == (2 if batch_id == 1 else 1):
            cut["left"] -= 1
            with pytest.MonkeyPatch.context() as m:
                m.setattr(tables, "commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
                daily.take_batch(part, batch_id, f"{path}/t")
        daily.take_batch(part, batch_id, f"{path}/t")

    start = lambda: source(spark, path, LOG).writeStream.foreachBatch(take)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            run(start(), f"{path}/cp")
    run(start(), f"{path}/cp")
    df = spark.createDataFrame(rows, LOG)
    of = lambda kind: df.where(F.col("kind") == kind)
    want = reports.daily_summary(of("trade"), of("equity"), of("alert").withColumn("event_type", F.lit("runtime_alert")))
    expected = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, daily.summary(spark, f"{path}/t").select(want.columns).collect())) == expected
    daily.take_batch(df.limit(0), 4, f"{path}/t2")
    assert daily.summary(spark, f"{path}/t2").collect() == []
    # a repeated batch changes nothing, and old versions can go
    daily.take_batch(spark.createDataFrame(rows[240:], LOG), 4, f"{path}/t")
    assert tables.vacuum(spark, f"{path}/t", "report_date") > 5
    assert tables.vacuum(spark, f"{path}/t", "report_date") == 0
    assert sorted(map(tuple, daily.summary(spark, f"{path}/t").select(want.columns).collect())) == expected


def test_log_rows(spark):
    row = lambda ddl, *r: spark.createDataFrame([r], ddl)
    events = spark.createDataFrame([(1, at(3), "runtime_alert"), (2, at(4), "other")], "id int, ts timestamp, event_type string")
    got = daily.log_rows(row("id long, ts timestamp", 7, at(1)), row("id long, ts timestamp, equity double", 8, at(2), 5.0), events)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("trade", at(1), 7, None), ("equity", at(2), 8, 5.0), ("alert", at(3), 1, None)], key=str)


def test_counts_outlive_recent_progress_and_restarts(spark, tmp_path):
    """The session keeps two reports only; late rows of the first batches are still counted at the end."""
    path = str(tmp_path)
    late_first = [[(0, "x", "A", at(1000), 1.0, 1.0, 1.0, 1.0)], [(1, "x", "A", at(2000), 1.0, 1.0, 1.0, 1.0)], [(2, "x", "A", at(3), 1.0, 1.0, 1.0, 1.0), (3, "x", "B", at(4), 1.0, 1.0, 1.0, 1.0)]]
    later = [[(10 + k, "x", "A", at(3000 + k), 1.0, 1.0, 1.0, 1.0)] for k in range(6)]
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    watching = monitor.watch(spark)
    try:
        feed(spark, path, late_first + later[:3], TICK, range(6))
        write = lambda: stream.stream_bars(source(spark, path, TICK), 60, "1 minute").writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").queryName("watched")
        q = run(write(), f"{path}/cp")
        feed(spark, path, later[3:], TICK, range(6, 9))
        q2 = run(write(), f"{path}/cp")
        assert q.id == q2.id and len(q2.recentProgress) <= 2
        for _ in range(100):
            h = watching.health(q.id)
            if h.rows == 10 and h.starts == 2 and not h.running:
                break
            time.sleep(0.1)
        # a row that is dropped counts once for each of its groups
        assert (h.name, h.starts, h.rows, h.late_rows, h.errors, h.running) == ("watched", 2, 10, 2, 0, False)
        assert h.batches >= 9 and watching.stalled(0.0, time.time() + 60) == []
        assert sum(s["numRowsDroppedByWatermark"] for p in q2.recentProgress for s in p["stateOperators"]) == 0
    finally:
        spark.streams.removeListener(watching)
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)


def test_a_failed_query_and_a_stall_are_seen(spark, tmp_path):
    path = str(tmp_path)
    feed(spark, path, [[(0, "x", "A", at(0), 1.0, 1.0, 1.0, 1.0)]], TICK, range(1))
    watching = monitor.watch(spark)
    try:
        q = source(spark, path, TICK).writeStream.foreachBatch(lambda rows, n: (_ for _ in ()).throw(OSError("full"))).option("checkpointLocation", f"{path}/cp").start()
        with pytest.raises(Exception, match="full"):
            q.awaitTermination()
        for _ in range(100):
            h = watching.health(q.id)
            if h.errors:
                break
            time.sleep(0.1)
        assert h.errors == 1 and "full" in h.error and not h.running
        watching._health["other"] = monitor.Health(running=True, last_seen=100.0)
        assert watching.stalled(30.0, 120.0) == [] and watching.stalled(30.0, 131.0) == ["other"]
    finally:
        spark.streams.removeListener(watching)
