"""Work dealt by rows where Spark would deal it by bytes, which say little of rows that are made of few bytes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

#: Rows of a task: a table of few bytes lies in one file that one task reads, and what it is made into has many.
ROWS = 1 << 15


def parts_of(rows: int, per_task: int = ROWS) -> int:
    return max(1, math.ceil(rows / per_task))


def spread(df: DataFrame, *by: str, rows: int | None = None, per_task: int = ROWS) -> DataFrame:
    """df in as many tasks as its rows ask for, dealt by columns if any are named; a number that is given is not put together again by size. rows: how many there are, if known."""
    n = parts_of(df.count() if rows is None else rows, per_task)
    return df if n == 1 and not by else df.repartition(n, *by)


def dealt(df: DataFrame, parts: int | None, *by: str) -> DataFrame:
    """df in so many tasks, dealt by columns; where no number is given, Spark deals it, by its bytes."""
    return df if parts is None else df.repartition(parts, *by)


def unbroadcast(df: DataFrame) -> DataFrame:
    """A side of a join that is never sent whole to the driver and each executor: Spark takes what is exploded or aggregated to be as small as the file it was read from."""
    return df.hint("shuffle_merge")
