"""Structured Streaming forms of the keyed state operators. Extensions: the batch forms are in ``operators``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.memory import fold

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Event files as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_outcomes(outcomes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first outcome of each prediction_id that arrives; state older than ``delay`` is dropped."""
    return outcomes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["prediction_id"])


def memory_state(log: DataFrame) -> DataFrame:
    """The memory fold over a log that grows; write it in complete or update mode."""
    return fold(log)


def status_by_window(log: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events by status and tumbling window; late events beyond ``delay`` are dropped."""
    return log.withWatermark("ts", delay).groupBy(F.window("ts", window), "status").agg(F.count(F.lit(1)).alias("n"))
