"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it again: the files survive the loss of any executor.  Where the
setting is missing and Spark runs in local mode (tests), a temporary folder is
used; on a cluster a missing setting is an error, since a machine-local folder
would not be seen by the other machines.  Tables that no later one reads are deleted
at once; ``clear`` deletes the others when an application is done with its results.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A task of an explicit shuffle is given about so many bytes at most.
TASK_BYTES = 256 << 20
_LOCAL: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="ferrule-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/ferrule-{uuid.uuid4().hex[:12]}-{name}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a reader over what was written."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the path, for tables that ``discard`` may delete later."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no later table reads any more."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; no result that still reads them may be used afterwards."""
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        discard(spark, path)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Keep Arrow batches small in rows and bytes, so that batches of long texts fit a Python worker.

    Plans read these settings when they run, so they stay for the session; smaller ones are left alone.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def partitions(spark: SparkSession, size: int = 0) -> int:
    """Tasks for a shuffle of ``size`` bytes: the session's number, or more where tasks would exceed ``TASK_BYTES``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // TASK_BYTES), 1)
