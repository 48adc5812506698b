"""Series cleaning: filters, normalisation, trends, clipping and scatter.

Observations are long-form rows ``(series_id, part_id, seq, t, v, q)``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasemill.operators.medians import grouped_mad, grouped_median
from phasemill.operators.ordered import bracketing, numbered, segmented
from phasemill.operators.rangejoin import point_join
from phasemill.session import cut_lineage

BIWEIGHT_C = 6.0
MAD_SCALE = 1.4826
SERIES = ["series_id"]
PART = ["series_id", "part_id"]


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def quality_filter(obs: DataFrame) -> DataFrame:
    """Rows with a zero quality flag and a finite time and value."""
    return obs.filter((F.col("q") == 0) & finite("t") & finite("v"))


def bitmask_filter(df: DataFrame, flags: str, mask: int) -> DataFrame:
    return df.filter(F.col(flags).bitwiseAND(F.lit(mask)) == 0)


def covered_by(point: Column, lo: Column, hi: Column, closed: Column) -> Column:
    """Point in interval, with ``closed`` one of both, left, right, neither."""
    left = F.when(closed.isin("both", "left"), point >= lo).otherwise(point > lo)
    right = F.when(closed.isin("both", "right"), point <= hi).otherwise(point < hi)
    return left & right


def interval_hits(obs: DataFrame, masks: DataFrame, point: str, width: float) -> DataFrame:
    """Observations a mask covers, with the sorted ids of the masks that hit.

    Masks per row are few, the hit list is bounded by the mask table.
    """
    hit = point_join(obs, masks, PART, point, "lo", "hi", width,
                     covered_by(F.col(point), F.col("lo"), F.col("hi"), F.col("closed")))
    return hit.groupBy("series_id", "part_id", "seq").agg(F.sort_array(F.collect_set("interval_id")).alias("hits"))


def normalise_parts(obs: DataFrame) -> DataFrame:
    """Divide each part by its median; a part without a positive median is invalid."""
    med = grouped_median(obs, PART, F.col("v"), "part_median")
    x = obs.join(med, PART)
    return (x.withColumn("norm_status", F.when(F.col("part_median") > 0, "ok").otherwise("invalid_normalization"))
             .withColumn("nv", F.when(F.col("part_median") > 0, F.col("v") / F.col("part_median"))))


def _middle(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Median of each row of a matrix sorted along its rows, of which ``length`` leading values count."""
    at = np.arange(len(rows))
    return (rows[at, (length - 1) // 2] + rows[at, length // 2]) / 2


def biweight(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Tukey biweight location of the ``length`` leading values of each sorted row, NaN behind them: three steps from the median, frozen when degenerate."""
    m = _middle(x, length)
    moving = np.ones(len(x), dtype=bool)
    for _ in range(3):
        mad = _middle(np.sort(np.abs(x - m[:, None]), axis=1), length)
        with np.errstate(divide="ignore", invalid="ignore"):
            u = (x - m[:, None]) / (BIWEIGHT_C * mad[:, None])
            weight = np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0.0)
        total = weight.sum(axis=1)
        moving &= (mad > 0) & (total > 0)
        m = np.where(moving, np.nansum(weight * x, axis=1) / np.where(moving, total, 1.0), m)
    return m


def _centres(t: np.ndarray, y: np.ndarray, at: np.ndarray, half_window: float, budget: int = 1 << 19) -> np.ndarray:
    """Biweight of ``y`` within ``half_window`` of each time in ``at``; ``t`` and ``at`` are sorted.

    Windows are the rows of a matrix, filled up with NaN, of at most ``budget`` elements or one
    window. Missing values are left out; a window without values has the centre NaN.
    """
    lo, hi = np.searchsorted(t, at - half_window, "left"), np.searchsorted(t, at + half_window, "right")
    length, out = hi - lo, np.empty(len(at))
    rows = max(1, budget // int(length.max(initial=1)))
    for i in range(0, len(at), rows):
        k = length[i:i + rows]
        j = np.arange(k.max(initial=1))
        inside = j < k[:, None]
        x = np.sort(np.where(inside, y[np.where(inside, lo[i:i + rows, None] + j, 0)], np.nan), axis=1)
        out[i:i + rows] = biweight(x, np.count_nonzero(~np.isnan(x), axis=1))
    return out


def _stencil(half_window: float):
    def centres(t: pd.Series, y: pd.Series, anchor: pd.Series) -> pd.Series:
        out = []
        for t1, y1, a1 in zip(t, y, anchor):
            t1, a1 = np.asarray(t1, dtype=float), np.asarray(a1, dtype=bool)
            at = np.unique(t1[a1])
            out.append([{"t": p, "centre": c} for p, c in zip(at, _centres(t1, np.asarray(y1, dtype=float), at, half_window)) if c == c])
        return pd.Series(out)
    return centres


def anchor_centres(x: DataFrame, keys: list[str], *, stride: int, half_window: float, value: str) -> DataFrame:
    """Biweight centre at every ``stride``-th and the last point of each run.

    ``x`` carries ``_n``, the 1-based position in the run, and ``_size``, its length. A run is cut
    into blocks of four half windows; a point within half a window of a block's edge is also sent
    to the neighbour as halo, so a point is in two blocks at most and a block answers for its own
    anchors alone. A block holds six half windows, so its length is bounded by the instrument.
    """
    width, reach = 4 * half_window, half_window * (1 + 1e-9) + 1e-9  # no rounding of an edge loses a point
    t = F.col("t")
    block = lambda c: F.floor(c / width)
    anchor = ((F.col("_n") - 1) % stride == 0) | (F.col("_n") == F.col("_size"))
    sent = x.select(*keys, "t", F.col(value).alias("_y"), anchor.alias("_a"),
                    F.explode(F.array_distinct(F.array(block(t - reach), block(t), block(t + reach)))).alias("_block"))
    own = F.col("_a") & (F.col("_block") == block(t))
    blocks = sent.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct("t", "_y", own.alias("own")))).alias("_p"))
    blocks = blocks.filter(F.exists("_p", lambda p: p["own"]))
    found = F.pandas_udf(_stencil(half_window), "array<struct<t:double,centre:double>>")
    return blocks.select(*keys, F.explode(found("_p.t", "_p._y", "_p.own")).alias("_r")).select(*keys, "_r.*")


def interpolated(lo_t: str, lo_y: str, hi_t: str, hi_y: str, t: str) -> Column:
    """Piecewise linear between two anchors, flat outside."""
    lo_t, lo_y, hi_t, hi_y, t = map(F.col, (lo_t, lo_y, hi_t, hi_y, t))
    return (F.when(lo_t.isNull(), hi_y).when(hi_t.isNull(), lo_y).when(hi_t == lo_t, lo_y)
            .otherwise(lo_y + (hi_y - lo_y) * (t - lo_t) / (hi_t - lo_t)))


def biweight_trend(obs: DataFrame, *, value: str = "v", gap_days: float, stride: int = 10, half_window: float = 0.5,
                   chunk_days: float = 7.5) -> DataFrame:
    """Add ``segment_id`` and ``trend``: moving biweight between anchors, per run of each part.

    Runs break where the step exceeds ``gap_days``; a run of under three points takes its median.
    """
    chunk = F.floor(F.col("t") / chunk_days)
    x = segmented(obs, PART, ["t", "seq"], "t", gap_days, chunk, position="_n")
    keys = PART + ["segment_id"]
    # Anchors, windows and interpolation all read the numbered runs: written once.
    x = cut_lineage(x)
    x = x.join(x.groupBy(*keys).agg(F.max("_n").alias("_size")), keys)
    centres = cut_lineage(anchor_centres(x, keys, stride=stride, half_window=half_window, value=value))
    joined = x.join(centres, keys + ["t"], "left").withColumn("_at", F.col("t"))
    span = bracketing(joined, keys, ["t", "seq"], F.col("centre").isNotNull(), ["_at", "centre"], chunk)
    short = grouped_median(x.filter("_size < 3"), keys, F.col(value), "_short", bounded=True)
    trend = interpolated("lo__at", "lo_centre", "hi__at", "hi_centre", "t")
    return (span.join(short, keys, "left").withColumn("trend", F.coalesce(F.col("_short"), trend))
            .select(*obs.columns, "segment_id", "trend"))


def quadratic_trend(obs: DataFrame, *, value: str = "v", half: int, block: int = 4096) -> DataFrame:
    """Add ``trend``: centred quadratic least squares over ``2*half+1`` points of each part.

    A part is cut into blocks of ``block`` points; points within ``half`` of an
    edge are copied to the neighbouring block, so no window spans a whole part.
    Points without a full window take the nearest full window's polynomial.
    """
    n = 2 * half + 1
    s2 = half * (half + 1) * n / 3.0
    s4 = s2 * (3 * half * half + 3 * half - 1) / 5.0
    x = numbered(obs, PART, ["t", "seq"], F.floor(F.col("t") / 7.5), "_n").withColumn("_own", F.floor((F.col("_n") - 1) / block))
    near = F.array_distinct(F.array(F.floor((F.col("_n") - 1 - half) / block), F.col("_own"), F.floor((F.col("_n") - 1 + half) / block)))
    copies = x.withColumn("_blk", F.explode(near)).withColumn("_k", (F.col("_n") - 1 - F.col("_blk") * block).cast("double"))
    w = Window.partitionBy(*PART, "_blk").orderBy("_n").rowsBetween(-half, half)
    y, k = F.col(value), F.col("_k")
    sums = copies.withColumns({"_c": F.count(F.lit(1)).over(w), "_s0": F.sum(y).over(w), "_s1": F.sum(k * y).over(w),
                               "_sq": F.sum(k * k * y).over(w)}).filter(F.col("_blk") == F.col("_own"))
    d1 = F.col("_s1") - k * F.col("_s0")
    d2 = F.col("_sq") - 2 * k * F.col("_s1") + k * k * F.col("_s0")
    full = F.col("_c") == n
    sums = sums.withColumns({
        "_a0": F.when(full, (s4 * F.col("_s0") - s2 * d2) / (n * s4 - s2 * s2)),
        "_a1": F.when(full, d1 / s2),
        "_a2": F.when(full, (n * d2 - s2 * F.col("_s0")) / (n * s4 - s2 * s2))})
    fit = F.struct("_n", "_a0", "_a1", "_a2")
    edge = sums.filter(full).groupBy(*PART).agg(F.min_by(fit, "_n").alias("_f"), F.max_by(fit, "_n").alias("_l"))
    x = sums.join(edge, PART, "left")
    use = F.when(F.col("_n") < F.col("_f._n"), F.col("_f")).otherwise(F.col("_l"))
    off = F.col("_n") - use["_n"]
    trend = F.when(full, F.col("_a0")).otherwise(use["_a0"] + use["_a1"] * off + use["_a2"] * off * off)
    return x.withColumn("trend", trend).select(*obs.columns, "trend")


def clip_upper(x: DataFrame, *, value: str, n_sigma: float = 5.0, min_points: int = 500) -> DataFrame:
    """Divide by the trend, clip above ``1 + n_sigma`` pooled scatters, give row reasons and a series status."""
    bad = ~finite("trend") | (F.col("trend") <= 0)
    x = cut_lineage(x.withColumn("fd", F.when(~bad, F.col(value) / F.col("trend"))))
    stats = grouped_mad(x.filter(finite("fd")), SERIES, F.col("fd"))
    x = x.join(stats, SERIES, "left")
    kept = F.coalesce(F.col("fd") < 1 + n_sigma * F.col("scatter"), F.lit(False))
    x = x.withColumn("kept", kept).withColumn(
        "reason", F.when(bad, "invalid_trend").when(~F.col("kept"), "upper_clip"))
    status = x.groupBy(*SERIES).agg(F.count_if(F.col("reason") == "invalid_trend").alias("_bad"),
                                    F.count_if("kept").alias("n_kept"), F.count(F.lit(1)).alias("n_total"))
    status = status.withColumn("series_status", F.when(F.col("n_total") < min_points, "insufficient_observations")
                               .when(F.col("_bad") > 0, "numerical_failure")
                               .when(F.col("n_kept") >= min_points, "ok").otherwise("insufficient_observations"))
    return x.join(status.drop("_bad"), SERIES)


def local_scatter(obs: DataFrame, *, window_days: float, min_points: int) -> DataFrame:
    """Scatter per fixed time window, the series scatter where a window is sparse."""
    x = obs.withColumn("win", F.floor(F.col("t") / window_days).cast("bigint"))
    keys = SERIES + ["win"]
    counts = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    local = grouped_mad(x, keys, F.col("v"), median="local_med", scatter="local")
    whole = grouped_mad(x, SERIES, F.col("v"), median="global_med", scatter="global")
    return (counts.join(local, keys).join(whole, SERIES)
            .withColumn("scatter", F.when((F.col("n") >= min_points) & (F.col("local") > 0), F.col("local")).otherwise(F.col("global"))))


def interior(obs: DataFrame, *, gap_days: float, edge_hours: float, chunk_days: float = 7.5) -> DataFrame:
    """Points at least ``edge_hours`` from both ends of their run (runs split at steps >= gap)."""
    x = segmented(obs, SERIES, ["t", "seq"], "t", gap_days, F.floor(F.col("t") / chunk_days), inclusive=True)
    runs = x.groupBy("series_id", "segment_id").agg(F.min("t").alias("_s"), F.max("t").alias("_e"))
    edge = edge_hours / 24
    return x.join(runs, ["series_id", "segment_id"]).filter(
        (F.col("t") - F.col("_s") >= edge) & (F.col("_e") - F.col("t") >= edge)).drop("_s", "_e")
