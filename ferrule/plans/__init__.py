"""The registered queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL whose decimal literals are doubles."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)
        return f

    return register


def r3(expression: str) -> str:
    """SQL for three digits by the exact binary value."""
    return f"CAST(format('{{:.3f}}', CAST({expression} AS DOUBLE)) AS DOUBLE)"
