"""Joins against a side that is usually small, with its size checked first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LOOKUP_ROWS = 200_000


def checked(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> tuple[DataFrame, bool]:
    """(lookup, True) when the table has at most `max_rows` rows, else (df, False).

    At most `max_rows + 1` rows are fetched.  A table that fits comes back as a
    local relation, so it is computed once and its size is known to the planner.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return df, False
    return df.sparkSession.createDataFrame(head, df.schema), True


def lookup_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", max_rows: int = MAX_LOOKUP_ROWS
) -> DataFrame:
    """Join a per-group table: broadcast when it proves small, else a shuffle join.

    The shuffle join has no hint, so adaptive execution may still split skewed keys.
    """
    small, fits = checked(right, max_rows)
    return left.join(F.broadcast(small) if fits else small, list(on), how)
