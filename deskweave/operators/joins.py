"""Join help for small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest dimension, in rows, that is copied to every executor.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a dimension after counting it; a larger one is left to the optimizer's shuffle joins.

    The count reads at most ``rows`` + 1 rows. Meant for dimensions that are cheap to read, beside
    facts that would otherwise be shuffled on a possibly skewed key.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
