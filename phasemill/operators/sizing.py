"""Broadcast only what has been measured; deal rows over as many tasks as they need."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.session import cut_lineage

BROADCAST_ROWS = 2_000_000
TASK_ROWS = 1_500_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the frame is proven to stay below ``limit`` rows.

    The count stops at ``limit + 1`` rows. A larger frame is returned as it is,
    and the join shuffles.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def small_once(df: DataFrame, limit: int) -> DataFrame:
    """As ``small``, for a frame that is dear to compute: it is written once, and the count reads what was written."""
    return small(cut_lineage(df), limit)


def tasks_for(*frames: DataFrame, rows: int = TASK_ROWS) -> int:
    """Tasks that leave each about ``rows`` rows of the frames together, at any size.

    Shuffles of unknown size are merged up to a number of packed bytes, and rows of a few
    integers pack so well that one task's hash table is many times that.
    """
    return max(frames[0].sparkSession.sparkContext.defaultParallelism, math.ceil(sum(f.count() for f in frames) / rows))
