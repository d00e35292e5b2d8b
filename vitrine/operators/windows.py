"""Sliding windows over a positional column without one task per entity.

``partitionBy(entity)`` sends a whole entity (a conversation, a session) to one task. When the order
column is a position (0, 1, 2, ... inside the entity), the entity is cut into blocks of ``block``
positions; each row is also copied into the neighbouring block(s) whose rows can see it through the
frame (``before`` rows back, ``after`` rows ahead), the window runs per (entity, block), and only each
row's home copy is kept. Extra rows: (before + after) per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 1024


def blocked(df: DataFrame, pos: str, before: int, after: int, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``_blk`` (one row per block that needs it) and ``_home`` (the row's own block)."""
    p = F.col(pos)
    lo = F.floor((p - F.lit(after)) / F.lit(block))
    hi = F.floor((p + F.lit(before)) / F.lit(block))
    home = F.floor(p / F.lit(block))
    out = df.withColumn("_blk", F.explode(F.sequence(F.greatest(lo, F.lit(0)).cast("long"), hi.cast("long"))))
    return out.withColumn("_home", F.col("_blk") == home)


def block_window(key: str, pos: str) -> Window:
    return Window.partitionBy(key, "_blk").orderBy(pos)
