"""Size checks that decide how a small table is joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_SMALL_ROWS = 10_000


def small_side(df: DataFrame) -> DataFrame:
    """A narrow table for the small side of a join.

    Up to MAX_SMALL_ROWS rows it is read once and handed to every task. A longer table is
    returned as it is, so Spark plans an ordinary shuffled join.
    """
    rows = df.limit(MAX_SMALL_ROWS + 1).collect()
    if len(rows) > MAX_SMALL_ROWS:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
