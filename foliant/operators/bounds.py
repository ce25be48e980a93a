"""What may be broadcast, checked by counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for a broadcast if it has so few rows, else as it is. At most rows + 1 of them are counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
