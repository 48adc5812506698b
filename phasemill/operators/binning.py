"""Fixed, adaptive and folded bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasemill.functions.phase import phase_fold
from phasemill.operators.medians import grouped_mad, grouped_median
from phasemill.operators.ordered import segmented

EDGE_SNAP = 1e-8
PART = ["series_id", "part_id"]


def grid_bin(t: Column, start: Column, minutes: Column) -> Column:
    """Bin number on a grid; a point within 1e-8 bins of an edge belongs to that edge."""
    scaled = (t - start) * 1440 / minutes
    return F.floor(F.when(F.abs(scaled - F.rint(scaled)) <= EDGE_SNAP, F.rint(scaled)).otherwise(scaled)).cast("bigint")


def fixed_grid(obs: DataFrame, *, minutes: float, valid: Column, value: str = "v", max_bins: int = 20_000) -> DataFrame:
    """Mean per bin of a grid that starts at the first prepared time; empty bins stay, as null.

    The grid is bounded (``max_bins`` per part); an over-long part is one row without a bin, of status ``point_limit``.
    """
    return _grid(obs, F.lit(float(minutes)), valid, value, max_bins, "mean")


def adaptive_grid(obs: DataFrame, *, minutes: float, max_bins: int, reducer: str = "mean", value: str = "v") -> DataFrame:
    """As ``fixed_grid``, the bin width grown by a whole factor until the part fits ``max_bins``."""
    span = (F.max("t") - F.min("t")) * 1440
    factor = F.greatest(F.lit(1), F.floor(span / (minutes * max_bins)) + 1)
    # A last point that snaps onto the final edge needs one factor more.
    over = F.floor(span / (minutes * factor) + EDGE_SNAP) >= max_bins
    widths = obs.groupBy(*PART).agg((F.lit(float(minutes)) * (factor + F.when(over, 1).otherwise(0))).alias("minutes"))
    return _grid(obs.join(widths, PART), F.col("minutes"), F.lit(True), value, max_bins, reducer)


def _grid(obs: DataFrame, minutes: Column, valid: Column, value: str, max_bins: int, reducer: str) -> DataFrame:
    x = obs.withColumn("_min", minutes)
    starts = x.groupBy(*PART).agg(F.min("t").alias("start"), F.max("t").alias("_end"), F.max("_min").alias("bin_minutes"))
    starts = starts.withColumn("n_bins", grid_bin(F.col("_end"), F.col("start"), F.col("bin_minutes")) + 1)
    x = x.join(starts, PART).withColumn("bin", grid_bin(F.col("t"), F.col("start"), F.col("bin_minutes"))).filter(valid)
    keys = PART + ["bin"]
    if reducer == "median":
        cells = grouped_median(x, keys, F.col(value), "flux").join(x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)
    else:
        cells = x.groupBy(*keys).agg(F.avg(value).alias("flux"), F.count(F.lit(1)).alias("n"))
    fits = F.col("n_bins") <= max_bins
    bins = F.when(fits, F.sequence(F.lit(0).cast("bigint"), F.col("n_bins") - 1)).otherwise(F.array(F.lit(None).cast("bigint")))
    spine = starts.select(*PART, "start", "bin_minutes", "n_bins", F.when(fits, "ok").otherwise("point_limit").alias("status"), F.explode(bins).alias("bin"))
    return (spine.join(cells, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
            .withColumn("centre", F.col("start") + (F.col("bin") + 0.5) * F.col("bin_minutes") / 1440))


def grid_summary(grid: DataFrame) -> DataFrame:
    """Per part: its status, bins, filled bins, kept points and the scatter of the filled bins."""
    head = grid.groupBy(*PART, "status").agg(F.count("bin").alias("n_bins"), F.count("flux").alias("n_filled"), F.sum("n").alias("n_kept"))
    return head.join(grouped_mad(grid.filter(F.col("flux").isNotNull()), PART, F.col("flux"), bounded=True), PART, "left")


def runs(grid: DataFrame, *, empty: bool) -> DataFrame:
    """[first, last] bin of each run of empty (or filled) bins of a grid; a part over the limit has no bins, so no runs."""
    rows = grid.filter(F.col("bin").isNotNull() & (F.col("flux").isNull() if empty else F.col("flux").isNotNull()))
    x = segmented(rows, PART, ["bin"], "bin", 1, F.floor(F.col("bin") / 4096), "run")
    return x.groupBy(*PART, "run").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"),
                                       F.min("centre").alias("t_first"), F.max("centre").alias("t_last"))


def folded_medians(obs: DataFrame, *, period: Column, reference: Column, bins: int, value: str = "v") -> DataFrame:
    """Median, scatter (plain MAD) and count per phase bin of each series."""
    x = obs.withColumn("bin", F.least(F.floor(phase_fold(F.col("t"), reference, period) * bins), F.lit(bins - 1)).cast("bigint"))
    keys = ["series_id", "bin"]
    stats = grouped_mad(x, keys, F.col(value))
    return stats.join(x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)


def folded_means(obs: DataFrame, *, period: Column, reference: Column, bins: int, min_count: int) -> DataFrame:
    """Mean per phase bin over two cycles in view: each phase at -1, 0 and +1 turns, kept in [-1, 1)."""
    cells = (obs.withColumn("b", F.least(F.floor(phase_fold(F.col("t"), reference, period) * bins), F.lit(bins - 1)).cast("bigint"))
             .groupBy("series_id", "b").agg(F.avg("v").alias("mean_v"), F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") >= min_count))
    # Repeat the bounded bins, not the points.
    return (cells.select("series_id", F.explode(F.array(F.lit(-1), F.lit(0))).alias("turn"), "b", "mean_v", "n")
            .select("series_id", (F.col("b") + F.col("turn") * bins).alias("view_bin"), "mean_v", "n"))


def overlapping_medians(obs: DataFrame, *, phase: Column, bins: int, width: float) -> DataFrame:
    """Median per overlapping phase bin; bin i is centred at (i+0.5)/bins and ``width`` wide.

    A point falls in at most ceil(width*bins)+1 bins, found by arithmetic instead of a range join.
    """
    x = obs.withColumn("_p", phase)
    lo = F.ceil((F.col("_p") - width / 2) * bins - 0.5)
    hi = F.floor((F.col("_p") + width / 2) * bins - 0.5)
    first, last = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(bins - 1))
    x = x.filter(first <= last).withColumn("bin", F.explode(F.sequence(first, last)))
    return grouped_median(x, ["series_id", "bin"], F.col("v"), "med")
