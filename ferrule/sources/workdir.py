"""A folder for files that a query writes and reads again: below ``spark.checkpoint.dir``, which all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A new path; a machine-local folder only where Spark runs in one process and the setting is missing."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.conf.get("spark.master", "") or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/ferrule-files-{uuid.uuid4().hex[:12]}/{name}"
