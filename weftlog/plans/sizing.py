"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a narrow table that is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has ``limit`` rows at most. It is counted up to there, so it should be written already."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
