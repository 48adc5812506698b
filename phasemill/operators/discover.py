"""Discoverability, paired-block equivalence and synthetic noise."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from phasemill.functions.phase import in_window, phase_distance
from phasemill.operators.cleaning import interior
from phasemill.operators.matching import event_points
from phasemill.operators.medians import grouped_mad
from phasemill.operators.models import remove_models
from phasemill.operators.peaks import local_maxima
from phasemill.session import cut_lineage


def critical(n: int, level: float = 0.001) -> float:
    """Student-t quantile at 1 - level/n with n - 1 degrees of freedom; NaN below two blocks.

    For a whole number of degrees f, P(|T| <= sqrt(f) tan a) is a finite sum in sin a and cos a; bisection finds a.
    """
    f = int(n) - 1
    if f < 1:
        return math.nan
    j = np.arange(1, (f - 1) // 2 if f % 2 else f // 2)
    terms = np.cumprod(np.concatenate([[1.0], 2 * j / (2 * j + 1) if f % 2 else (2 * j - 1) / (2 * j)]))
    power = 2 * np.arange(len(terms)) + f % 2
    lo, hi = 0.0, math.pi / 2
    for _ in range(100):
        a = (lo + hi) / 2
        tail = math.sin(a) * float(terms @ math.cos(a) ** power) if f > 1 else 0.0
        inside = 2 / math.pi * (a + tail) if f % 2 else tail
        lo, hi = (a, hi) if inside < 1 - 2 * level / n else (lo, a)
    return math.sqrt(f) * math.tan(lo)


@F.pandas_udf(DoubleType())
def critical_of(n: pd.Series) -> pd.Series:
    return n.map({k: critical(k) for k in n.unique()})


def discoverable(points: DataFrame, pg: DataFrame, models: DataFrame, *, value: str, grid: tuple[float, float, int], snr_min: float = 7.0,
                 sde_min: float = 6.0, min_transits: int = 2, coverage: float = 0.5, cadence_days: float = 0.25, half_cells: int = 3,
                 gap_days: float = 0.5, edge_hours: float = 12.0, min_points: int = 1) -> DataFrame:
    """Whether a strict, gated maximum with enough covered events matches each (series_id, model_id).

    ``pg`` is searched on a grid of equal steps in log period, and cells are such steps; a peak matches within
    ``half_cells`` and half the longer duration in epoch. A series with too few points, or without scatter, is not
    measured: its counts and its answer are null.
    """
    lo, hi, n = grid
    peaks = local_maxima(pg, ["series_id"], "idx", "power", strict=True).filter((F.col("snr") >= snr_min) & (F.col("sde") >= sde_min))
    peaks = peaks.select("series_id", "idx", "period", "epoch", "duration")
    inside = interior(points.select("series_id", "part_id", "seq", "t"), gap_days=gap_days, edge_hours=edge_hours).select("series_id", "t")
    per = event_points(inside, peaks).groupBy("series_id", "idx", "k").agg(F.count(F.lit(1)).alias("_k"), F.first("duration").alias("_d"))
    seen = per.filter(F.col("_k") >= coverage * F.col("_d") / cadence_days).groupBy("series_id", "idx").agg(F.count(F.lit(1)).alias("n_transits"))
    good = peaks.join(seen.filter(F.col("n_transits") >= min_transits), ["series_id", "idx"])
    m = models.select("series_id", "model_id", F.col("period").alias("m_period"), F.col("epoch").alias("m_epoch"), F.col("duration").alias("m_duration"))
    cell = math.log(hi / lo) / (n - 1)
    hit = ((F.abs(F.log(F.col("period") / F.col("m_period"))) / cell <= half_cells)
           & (F.abs(phase_distance(F.col("epoch"), F.col("m_period"), F.col("m_epoch"))) <= F.greatest("duration", "m_duration") / 2))
    x = m.join(good, "series_id", "left").groupBy("series_id", "model_id", "m_period").agg(F.count("idx").alias("n_peaks"), F.count_if(hit).alias("n_matched"))
    counts = points.groupBy("series_id").agg((F.count(value) >= min_points).alias("_enough"))
    searched = pg.groupBy("series_id").agg(F.lit(True).alias("_searched"))
    x = x.join(counts, "series_id", "left").join(searched, "series_id", "left")
    status = (F.when(~F.coalesce("_enough", F.lit(False)), "input_insufficient").when(F.col("_searched").isNull(), "calculation_failed").otherwise("measured"))
    x = x.withColumn("status", status)
    measured = F.col("status") == "measured"
    outside = (F.col("m_period") < lo) | (F.col("m_period") > hi)
    reason = (F.when(F.col("status") == "input_insufficient", "insufficient_observations").when(~measured, "degenerate_flux").when(outside, "outside_provided_grid")
              .when(F.col("n_matched") > 0, "matched_peak").otherwise("no_matching_quality_peak"))
    own = lambda c: F.when(measured, c)
    return x.select("series_id", "model_id", "status", own(F.col("n_peaks")).alias("n_peaks"), own(F.col("n_matched")).alias("n_matched"),
                    own(~outside & (F.col("n_matched") > 0)).alias("discoverable"), reason.alias("reason"))


def prefix_run(points: DataFrame, models: DataFrame, search, *, value: str, steps: int, **rules) -> DataFrame:
    """Judge the candidates of each series in order, each on what the earlier ones leave.

    ``model_id`` counts from 1 to ``steps`` (the most candidates a series has); ``search`` makes the periodogram of
    points. One candidate that cannot be measured holds its whole series: ``decision`` is held for all of them.
    """
    out, left = None, points
    for step in range(1, steps + 1):
        if step > 1:
            kept = remove_models(points, models.filter(F.col("model_id") < step), value=value)
            left = cut_lineage(kept.select("series_id", "part_id", "seq", "t", F.col("residual").alias(value)).filter(F.col(value).isNotNull()))
        one = discoverable(left, search(left), models.filter(F.col("model_id") == step), value=value, **rules)
        out = one if out is None else out.unionByName(one)
    out = cut_lineage(out)  # read for the series' verdict and for its rows
    held = out.groupBy("series_id").agg(F.bool_or(F.col("status") != "measured").alias("_held"))
    decision = F.when(F.col("_held"), "held").when(F.col("discoverable"), "discoverable").otherwise("not_discoverable")
    return out.join(held, "series_id").withColumn("decision", decision).drop("_held")


def paired_blocks(points: DataFrame, *, short: tuple[float, float, float], long: tuple[float, float, float], value: str, min_points: int = 5,
                  min_blocks: int = 4, margin: float) -> DataFrame:
    """Do the odd and even events of a double period differ? One mean difference per block of the long period.

    Every block whose two events lie within the series' span must have ``min_points`` in each class;
    one that has not, be it wholly missing, holds the series (``missing_distinguishing_windows``).
    """
    ms, ml = in_window("t", *short), in_window("t", *long)
    p, e, d = long
    cls = F.when(ml, "y").when(ms, "x").otherwise("o")
    x = points.withColumn("_blk", F.floor((F.col("t") - e) / p + 0.25)).withColumn("_cls", cls)
    v = lambda c: F.when(F.col("_cls") == c, F.col(value))
    b = x.groupBy("series_id", "_blk").agg(*[f(v(c)).alias(f"{name}{c}") for c in "xyo" for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    b = b.filter((F.col("nx") >= min_points) & (F.col("ny") >= min_points) & (F.col("no") >= min_points))
    b = b.withColumns({"diff": F.col("mx") - F.col("my"), "err": F.sqrt(F.col("vx") / F.col("nx") + F.col("vy") / F.col("ny")), "depth": F.col("mo") - (F.col("mx") + F.col("my")) / 2})
    span = points.groupBy("series_id").agg(F.ceil((F.min("t") + d / 2 - e) / p).alias("_first"), F.floor((F.max("t") - d / 2 - p / 2 - e) / p).alias("_last"))
    b = span.join(b, "series_id", "left").withColumn("_in", F.coalesce(F.col("_blk").between(F.col("_first"), F.col("_last")), F.lit(False)))
    own = lambda c: F.when(F.col("_in"), F.col(c))
    s = b.groupBy("series_id").agg(F.greatest(F.first("_last") - F.first("_first") + 1, F.lit(0)).alias("expected_blocks"), F.count_if("_in").alias("paired_blocks"), F.avg(own("diff")).alias("mean_diff"),
                                   F.max(F.abs(own("diff"))).alias("max_diff"), F.min(own("depth")).alias("min_depth"),
                                   F.greatest(F.max(own("err")), F.try_divide(F.stddev_samp(own("diff")), F.sqrt(F.count_if("_in")))).alias("error"))
    s = s.withColumn("critical", critical_of("expected_blocks"))
    upper, lower = F.col("max_diff") + F.col("critical") * F.col("error"), F.abs(F.col("mean_diff")) - F.col("critical") * F.col("error")
    verdict = (F.when(F.col("paired_blocks") < F.col("expected_blocks"), "missing_distinguishing_windows").when(F.col("expected_blocks") < min_blocks, "insufficient_paired_blocks")
               .when(F.col("error") <= sys.float_info.epsilon, "noise_not_measurable")
               .when(F.col("min_depth") <= F.col("critical") * F.col("error"), "primary_depth_not_supported").when(upper < margin, "equivalent_within_margin")
               .when(lower > margin, "distinct_depth_pattern").otherwise("uncertainty_exceeds_margin"))
    return s.withColumn("verdict", verdict)


def noise_series(points: DataFrame, *, value: str, seed: int) -> DataFrame:
    """The same timestamps with Gaussian noise of the series' own scatter around 1.

    Two uniforms come from a hash of the row's key, so a retried task gives the same series.
    """
    u = lambda k: (F.pmod(F.xxhash64("series_id", "seq", F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))
    sc = grouped_mad(points, "series_id", F.col(value), median="_m", scatter="_sc").select("series_id", "_sc")
    return points.select("series_id", "part_id", "seq", "t").join(sc, "series_id").withColumn(value, 1 + F.col("_sc") * normal).drop("_sc")
