"""Columns by place, so that no column of a caller clashes with those an operator adds.

Operators read the columns they need by place and carry all others under numbers.
A column is found by its exact name, else by its name in another case; of
several, the first.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(df: DataFrame, name: str) -> int:
    names = df.columns
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named _c0, _c1, ... by place."""
    return df.toDF(*(f"_c{i}" for i in range(len(df.columns))))


def own(df: DataFrame, name: str) -> Column:
    """The column ``name`` of ``df``, in ``numbered(df)``."""
    return F.col(f"_c{place(df, name)}")


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns ``names`` of ``df``, under just these names."""
    return numbered(df).select(*(own(df, n).alias(n) for n in names))


def restored(df: DataFrame, without: Iterable[str] = ()) -> list[Column]:
    """The columns of ``df`` under their own names, in a table of ``numbered(df)``; not those called as in ``without``."""
    gone = {n.lower() for n in without}
    return [F.col(f"_c{i}").alias(n) for i, n in enumerate(df.columns) if n.lower() not in gone]
