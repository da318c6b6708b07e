"""Sinks: appends partitioned by day, and an upsert that rewrites only the days it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticksmith.operators.reports import upsert_latest
from ticksmith.sources.market import read_table


def append(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Append under the day of ``ts``, so that reports over days prune partitions. Each task writes the days that it
    holds; nothing is shuffled, so a busy day isn't one task's."""
    rows.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def upsert(rows: DataFrame, path: str, keys: list[str], order: list[str], ddl: str) -> None:
    """Keep the last row by ``order`` of each key; ``keys`` begin with the partition column.

    Only partitions that ``rows`` touch are read and overwritten; a failed job leaves the old ones.
    """
    spark, part = rows.sparkSession, keys[0]
    new = rows.select(*(c.split()[0] for c in ddl.split(", ")))
    touched = read_table(spark, path, ddl).join(new.select(part).distinct(), part, "left_semi").select(*new.columns)
    out = upsert_latest(touched.unionByName(new), keys, order)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
