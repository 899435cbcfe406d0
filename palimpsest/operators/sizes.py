"""Broadcasts behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for broadcast when it has at most so many (narrow) rows; otherwise Catalyst's own choice stands."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
