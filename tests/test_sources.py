"""Recorded responses as batch and stream, and appends in two phases."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from ticksmith.sources import log_table, payloads

UTC = dt.timezone.utc


def record(path, venue, pair, at, text):
    folder = f"{path}/venue={venue}/pair={pair}/day={at.date()}"
    os.makedirs(folder, exist_ok=True)
    name = f"{folder}/{int(at.timestamp() * 1000)}.json"
    with open(name, "w", encoding="utf-8") as f:
        f.write(text)
    os.utime(name, (at.timestamp(), at.timestamp()))


FIRI = '[{"id": "ETHNOK", "last": "9"},\n {"id": "BTCNOK", "last": "123.45", "todays_volume": "1.23"}]'
KRAKEN = '{"error": [], "result": {"BTCEUR": {"a": ["100.50"], "b": ["100.00"], "c": ["100.25"], "v": ["1", "4.56"]}}}'


def recorded(path):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h, tzinfo=UTC)
    for d in (1, 2, 3):
        record(path, "firi", "BTCNOK", day(d), FIRI)
        record(path, "kraken", "BTCEUR", day(d, 23), KRAKEN)
    record(path, "kraken", "ETHEUR", day(2), KRAKEN)
    record(path, "kraken", "BTCEUR", day(2, 5), '{"error": ["EService:Busy"]}')
    record(path, "firi", "BTCNOK", day(3, 1), "not json")
    record(path, "nowhere", "BTCNOK", day(3, 2), "{}")


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan
    return sum(plan.collectLeaves().apply(i).metrics().apply("numFiles").value() for i in range(plan.collectLeaves().size()))


def test_responses_become_ticks_or_reasons(spark, tmp_path):
    recorded(f"{tmp_path}")
    found = payloads.read_payloads(spark, f"{tmp_path}")
    got = sorted(tuple(r) for r in payloads.payload_ticks(found).collect())
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    assert got == sorted([("firi", "BTCNOK", at(d), 123.45, 123.45, 123.45, 1.23) for d in (1, 2, 3)] + [("kraken", "BTCEUR", at(d, 23), 100.0, 100.5, 100.25, 4.56) for d in (1, 2, 3)])
    assert sorted((r.venue, r.pair, r.reason) for r in payloads.rejected_payloads(found).collect()) == [("firi", "BTCNOK", "unsupported symbol"), ("kraken", "BTCEUR", "EService:Busy"), ("kraken", "ETHEUR", "unsupported symbol"), ("nowhere", "BTCNOK", "unknown venue")]


def test_files_of_other_pairs_and_days_are_not_opened(spark, tmp_path):
    recorded(f"{tmp_path}")
    found = payloads.read_payloads(spark, f"{tmp_path}")
    assert files_read(payloads.payload_ticks(found)) == 10
    assert files_read(payloads.payload_ticks(found).where("symbol = 'BTCEUR'")) == 4
    part = payloads.between(found, dt.datetime(2024, 1, 2, tzinfo=UTC), dt.datetime(2024, 1, 2, 6, tzinfo=UTC))
    assert files_read(part) == 3 and sorted(r.venue for r in part.collect()) == ["firi", "kraken", "kraken"]


def test_a_stream_of_responses_equals_the_batch(spark, tmp_path):
    """Stopped midway and started again from its checkpoint, with files that came between."""
    path = f"{tmp_path}/in"
    recorded(path)
    write = lambda: payloads.payload_ticks(payloads.read_payloads(spark, path, stream=True, files_per_batch=3)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    write().awaitTermination()
    record(path, "firi", "BTCNOK", dt.datetime(2024, 1, 4, tzinfo=UTC), FIRI)
    write().awaitTermination()
    want = payloads.payload_ticks(payloads.read_payloads(spark, path))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, want.collect()))
    assert want.count() == 7


DDL = "name string, n long"


def rows_of(spark, first, n, parts=4):
    return spark.range(first, first + n, 1, parts).select(F.concat(F.lit("r"), "id").alias("name"), F.col("id").alias("n"))


def test_ids_are_dense_over_appends(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert log_table.read(spark, path, DDL).collect() == []
    assert log_table.append(rows_of(spark, 0, 10), path) == log_table.Appended(1, 10)
    assert log_table.append(rows_of(spark, 0, 0), path) == log_table.Appended(11, 0)
    assert log_table.append(rows_of(spark, 10, 7, 3).where("n != 12"), path) == log_table.Appended(11, 6)
    got = {r.id: r.n for r in log_table.read(spark, path, DDL).collect()}
    assert got == dict(zip(range(1, 17), [*range(10), 10, 11, 13, 14, 15, 16], strict=True))


def test_a_task_that_fails_midway_leaves_no_rows(spark, tmp_path):
    path = f"{tmp_path}/t"
    log_table.append(rows_of(spark, 0, 5), path)
    bad = rows_of(spark, 5, 4000, 8).withColumn("n", F.when(F.col("n") == 3900, F.raise_error(F.lit("disk is full")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="disk is full"):
        log_table.append(bad, path)
    assert log_table.read(spark, path, DDL).count() == 5 and len([d for d in os.listdir(f"{path}/rows") if d.startswith("job=")]) == 1
    # a job that was written but not entered isn't seen, and can be entered once or forgotten
    job = log_table.prepare(rows_of(spark, 5, 3), path)
    assert log_table.read(spark, path, DDL).count() == 5
    assert log_table.commit(spark, path, job) == log_table.commit(spark, path, job) == log_table.Appended(6, 3)
    log_table.abort(spark, path, log_table.prepare(rows_of(spark, 9, 3), path))
    assert sorted(r.id for r in log_table.read(spark, path, DDL).collect()) == list(range(1, 9))


def test_writers_at_once_give_no_id_twice(spark, tmp_path):
    path, done = f"{tmp_path}/t", []
    jobs = [log_table.prepare(rows_of(spark, 10 * k, 10, 2), path) for k in range(4)]
    threads = [threading.Thread(target=lambda j=j: done.append(log_table.commit(spark, path, j))) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(a.first_id for a in done) == [1, 11, 21, 31]
    assert sorted(r.id for r in log_table.read(spark, path, DDL).collect()) == list(range(1, 41))
