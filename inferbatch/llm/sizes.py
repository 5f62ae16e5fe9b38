"""Size checks before a table is sent to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 16 << 20


def broadcast_if_small(written: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table of known row width for broadcast up to `most` bytes.

    Counting a written table reads file footers only. Beyond the bound the join is shuffled.
    """
    return F.broadcast(written) if written.count() * row_bytes <= most else written
