"""Join hints that rest on a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side of short rows for broadcast when it has at most ``max_rows`` rows.

    The count stops at the limit. A larger side gets no hint, and Spark plans a shuffled join.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
