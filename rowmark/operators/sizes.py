"""Broadcasts whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowmark.checkpoints import checkpoint_folder

BROADCAST_ROWS = 100_000


def settled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Compute a narrow frame once, and mark it for broadcast if it has at most `rows` rows.

    Beyond that Spark joins it by shuffle, where adaptive execution splits hot keys.
    """
    checkpoint_folder(df.sparkSession)
    kept = df.checkpoint()
    return F.broadcast(kept) if kept.count() <= rows else kept
