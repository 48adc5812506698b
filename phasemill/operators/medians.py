"""Exact grouped medians that survive a hot group.

Spark's ``median`` keeps every distinct value of a group in one buffer. Here a
bounded quantile sketch brackets the middle of each group first. Clamping every
value into that bracket leaves the median where it was, but collapses all other
rows into the two bracket ends during the map-side combine, and the counting
shuffle is keyed by (group, value): a group holding a third of all rows is
spread over all tasks and reaches its last step as a few rows per hundred
thousand. The bracket is checked by exact counts; a miss fails the job instead
of giving a wrong number.

Brackets and centres are one row per key. Below ``FEW`` rows they are broadcast, so
the rows meet them where they lie: dealt by key, a few keys would be a few
partitions, each sorted whole by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasemill.operators.sizing import small_once

ACCURACY = 100_000
MARGIN = 10 / ACCURACY
MAD_SCALE = 1.4826
#: Brackets and centres that are broadcast; more keys than these spread over tasks by themselves.
FEW = 100_000


def grouped_median(df: DataFrame, keys, value: Column, name: str, *, bounded: bool = False) -> DataFrame:
    """Exact median (mean of the two middles) of the non-null ``value`` per key.

    ``bounded`` says that the caller has proven the group size (bins of a fixed
    grid, say); the plain aggregate then does.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = df.select(*keys, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if bounded:
        return rows.groupBy(*keys).agg(F.median("_v").alias(name))
    bracket = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY).alias("_b"))
    lo, hi = F.col("_b")[0], F.col("_b")[1]
    placed = rows.join(small_once(bracket, FEW), keys).select(
        *keys, F.least(F.greatest("_v", lo), hi).alias("_v"),
        F.when(F.col("_v") < lo, -1).when(F.col("_v") > hi, 1).otherwise(0).alias("_side"))
    counts = placed.groupBy(*keys, "_v", "_side").agg(F.count(F.lit(1)).alias("_c"))
    return _middle(counts, keys, name)


def _middle(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Median from (value, side, count) rows: the sort spills, so the bracket may be large."""
    w = Window.partitionBy(*keys)
    x = counts.withColumns({"_n": F.sum("_c").over(w),
                            "_end": F.sum("_c").over(w.orderBy("_v", "_side"))})
    r0, r1 = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    holds = lambda r: (F.col("_end") - F.col("_c") <= r) & (F.col("_end") > r)
    hit = x.filter(holds(r0) | holds(r1))
    inside = F.when(F.col("_side") == 0, F.col("_v")).otherwise(F.raise_error(F.lit("median outside its bracket")).cast("double"))
    return hit.groupBy(*keys).agg(((F.min(inside) + F.max(inside)) / 2).alias(name))


def grouped_mad(df: DataFrame, keys, value: Column, *, median: str = "med", scatter: str = "scatter",
                bounded: bool = False) -> DataFrame:
    """Median and robust scatter, 1.4826 times the median absolute deviation, per key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    centre = grouped_median(df, keys, value, median, bounded=bounded)
    if not bounded:
        centre = small_once(centre, FEW)
    dev = df.select(*keys, value.cast("double").alias("_x")).join(centre, keys)
    # The centre is one value per key and rides along with the deviations.
    mad = grouped_median(dev, keys + [median], F.abs(F.col("_x") - F.col(median)), "_mad", bounded=bounded)
    return mad.select(*keys, median, (F.lit(MAD_SCALE) * F.col("_mad")).alias(scatter))
