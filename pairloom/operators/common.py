"""Size-checked broadcasts and lineage cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else as it is: the join is
    then shuffled.  The check stops at rows + 1."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
