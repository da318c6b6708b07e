"""Tables that a stream keeps: each micro-batch is merged in once, also if it is repeated after a failure.

A table is a folder of partitions by ``part``, each in versions: a batch writes new versions of the partitions that it
touches, made from older ones, and then its id into a ledger. Readers see the newest version that the ledger has. A batch
that was cut off before its entry isn't seen, and its repetition overwrites what it left, since it starts from versions
below its own id. No file that a reader may hold is changed; ``vacuum`` deletes versions that nobody needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticksmith.sources.market import read_table

Merge = dict[str, Callable[[str], Column]]


def _committed(spark: SparkSession, path: str) -> int:
    """The last batch in the ledger, or -1."""
    newest = read_table(spark, f"{path}/ledger", "batch long").agg(F.max("batch")).first()[0]
    return -1 if newest is None else newest


def _versions(spark: SparkSession, path: str, part: str, ddl: str, upto: int) -> DataFrame:
    """Rows of each partition's newest version up to ``upto``."""
    rows = read_table(spark, f"{path}/rows", f"{ddl}, version long").where(F.col("version") <= upto)
    # partition columns only: no file is read for this
    newest = rows.groupBy(part).agg(F.max("version").alias("version"))
    return rows.join(newest, [part, "version"], "left_semi").drop("version")


def current(spark: SparkSession, path: str, part: str, ddl: str) -> DataFrame:
    """The table after the last batch in the ledger; empty where there is none."""
    return _versions(spark, path, part, ddl, _committed(spark, path))


def apply_batch(rows: DataFrame, batch_id: int, path: str, keys: list[str], merge: Merge) -> None:
    """Merge a micro-batch's ``rows`` (keys, columns of ``merge``) into the table at ``path``; for ``foreachBatch``.

    ``keys`` begin with the partition column. ``merge``: how rows of one key come together, with functions whose order
    doesn't matter, such as sums, extremes, or the largest struct of a time and a value.
    """
    spark, part = rows.sparkSession, keys[0]
    rows = rows.select(*keys, *merge)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    older = _versions(spark, path, part, ddl, batch_id - 1).join(rows.select(part).distinct(), part, "left_semi")
    out = older.select(*rows.columns).unionByName(rows).groupBy(*keys).agg(*(f(c).alias(c) for c, f in merge.items()))
    out.withColumn("version", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part, "version").parquet(f"{path}/rows")
    commit(spark, batch_id, path)


def commit(spark: SparkSession, batch_id: int, path: str) -> None:
    """Enter a batch into the ledger; an entry of its own folder, so entering it twice changes nothing."""
    spark.range(1).select(F.lit(batch_id).cast("long").alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/entry={batch_id}")


def vacuum(spark: SparkSession, path: str, part: str) -> int:
    """Delete versions that are older than a partition's newest one in the ledger; how many. Not while a reader reads."""
    try:
        found = spark.read.parquet(f"{path}/rows").select(part, "version").distinct()
    except AnalysisException:
        return 0
    newest = found.where(F.col("version") <= _committed(spark, path)).groupBy(part).agg(F.max("version").alias("newest"))
    old = found.join(newest, part).where("version < newest").select(F.col(part).cast("string"), "version").collect()  # a row a folder
    for name, version in old:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/{part}={name or '__HIVE_DEFAULT_PARTITION__'}/version={version}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(old)
