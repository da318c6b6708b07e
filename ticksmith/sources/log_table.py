"""An append-only table with dense ids and two-phase commits: an append is seen whole or not at all.

First a job writes its rows to a folder of its own; if a task fails, the folder goes and nothing was appended. Then one
small log entry makes it part of the table: it has the job's name, its first id and where each task's rows begin. Entries
are numbered without gaps and made by a rename that fails if the number is taken; who is late takes the next one, so two
writers never give an id twice. Readers see the jobs that the log has.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of ``monotonically_increasing_id`` that count a task's rows; the bits above are the task.
_BITS = 33
_ENTRY = "number long, job string, first_id long, rows long, tasks array<struct<task: long, begin: long>>"


@dataclass(frozen=True)
class Appended:
    first_id: int
    rows: int


def _entries(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_ENTRY).option("pathGlobFilter", "*.json").json(f"{path}/log")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _ENTRY)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm, True)


def prepare(rows: DataFrame, path: str) -> str:
    """The first phase: write ``rows`` where no reader looks; gives the job's name. Nothing stays if a task fails."""
    job = uuid.uuid4().hex
    try:
        rows.withColumn("_place", F.monotonically_increasing_id()).write.parquet(f"{path}/rows/job={job}")
    except Exception:
        abort(rows.sparkSession, path, job)
        raise
    return job


def abort(spark: SparkSession, path: str, job: str) -> None:
    """Forget a job that isn't in the log."""
    _remove(spark, f"{path}/rows/job={job}")


def commit(spark: SparkSession, path: str, job: str) -> Appended:
    """The second phase: one log entry. A job that the log has already isn't entered again."""
    task = F.shiftrightunsigned("_place", _BITS)
    sizes = spark.read.parquet(f"{path}/rows/job={job}").groupBy(task.alias("task")).agg(F.count("*").alias("n"))
    # a row a task
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = [{"task": r.task, "begin": r.begin} for r in sizes.select("task", "n", before.alias("begin")).orderBy("task").collect()]
    rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    while True:
        log = _entries(spark, path)
        if own := log.where(F.col("job") == job).select("first_id", "rows").first():
            return Appended(*own)
        last = log.agg(F.max("number").alias("number"), F.max(F.col("first_id") + F.col("rows")).alias("next")).first()
        number, first = (last.number or 0) + 1, last.next or 1
        if _publish(spark, f"{path}/log", number, {"number": number, "job": job, "first_id": first, "rows": rows, "tasks": tasks}):
            return Appended(first, rows)


def _publish(spark: SparkSession, folder: str, number: int, entry: dict) -> bool:
    """Make entry ``number``, complete at once; False if someone has made it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    Path, Rename = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Options.Rename
    draft, final = Path(f"{folder}/.draft-{uuid.uuid4().hex}"), Path(f"{folder}/{number:012d}.json")
    fs = draft.getFileSystem(conf)
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(Rename, 1)
    options[0] = Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(draft).toUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(final), options)
        return True
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        return False
    finally:
        fs.delete(draft, False)


def append(rows: DataFrame, path: str) -> Appended:
    """Append ``rows``: their first id and how many they are. Ids go by task and place in it."""
    return commit(rows.sparkSession, path, prepare(rows, path))


def read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The table's rows with their ``id``; empty where nothing has been appended."""
    parts = _entries(spark, path).select("job", "first_id", F.explode("tasks").alias("t")).select("job", F.col("t.task").alias("_task"), (F.col("first_id") + F.col("t.begin")).alias("_begin"))
    try:
        rows = spark.read.schema(f"{ddl}, _place long, job string").parquet(f"{path}/rows")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], f"{ddl}, _place long, job string")
    names = [c for c in rows.columns if c not in ("_place", "job")]
    found = rows.withColumn("_task", F.shiftrightunsigned("_place", _BITS)).join(parts, ["job", "_task"])
    return found.select((F.col("_begin") + F.col("_place").bitwiseAND((1 << _BITS) - 1)).alias("id"), *names)
