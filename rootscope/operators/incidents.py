"""Incident keys: operators that take `by` work on many incidents in the jobs of one.

Inside an operator the keys are one struct column, whose nulls equal each other in joins, groups and windows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "__by"


def keys(by: Sequence[str]) -> list[str]:
    return [KEY] if by else []


def packed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """df with the columns of `by` as one."""
    return df.select(F.struct(*(F.col(b).alias(b) for b in by)).alias(KEY), *(c for c in df.columns if c not in by)) if by else df


def unpacked(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.select(*(F.col(KEY)[b].alias(b) for b in by), *(c for c in df.columns if c != KEY)) if by else df


def beside(df: DataFrame, one: DataFrame, by: Sequence[str]) -> DataFrame:
    """df with the row that `one` has for each incident (nulls where it has none), or its only row."""
    return df.join(one, KEY, "left") if by else df.crossJoin(F.broadcast(one))  # one row


def everywhere(name: str | DataFrame, incidents: DataFrame, by: Sequence[str], col: str = "service") -> DataFrame:
    """A name for each incident: the same for all of `incidents` (packed), or as a table (by, col) gives it."""
    if not isinstance(name, str):
        return packed(name.toDF(*by, col), by)
    if by:
        return incidents.select(KEY).distinct().select(KEY, F.lit(name).alias(col))
    return incidents.sparkSession.createDataFrame([(name,)], f"{col} string")


def by_incident(f: Callable) -> Callable:
    """f with its tables' incident keys as one column: f gets `by` as the names of that column, or none. Every table that it gets has the keys."""

    @functools.wraps(f)
    def wrapped(*args, by: Sequence[str] = (), **more):
        if not by or tuple(by) == (KEY,):
            return f(*args, by=tuple(by), **more)
        pack = lambda x: packed(x, by) if isinstance(x, DataFrame) else x
        return unpacked(f(*map(pack, args), by=(KEY,), **{k: pack(x) for k, x in more.items()}), by)

    return wrapped
