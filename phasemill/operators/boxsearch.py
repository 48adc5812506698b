"""Periodic box search.

Points are first summed into fixed time cells (map-side combine, bounded per
series). A series is then one row and moves once; only where cells x trial periods
exceed ``WORK`` is its grid split into as many rows as that takes, so one long series
spreads over the cluster and short ones are never copied. Inside a task the grid is
searched in blocks of ``BLOCK`` elements, so memory does not grow with cells x periods.
Values are scaled to whole numbers before any summing; sums are exact and a retried
task gives the same bits.

Box likelihood with equal weights: depth = mean outside - mean inside,
error = sigma * sqrt(1/n_in + 1/n_out), power = n_in * depth^2 / (2 sigma^2),
dips only, sigma from the scaled median absolute deviation.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasemill.operators.medians import grouped_mad

SCALE = 1_000_000_000
#: Cells x trial periods of one row (some ten seconds), and matrix elements held at a time (about 50 bytes each).
WORK, BLOCK = 1 << 28, 1 << 20
RESULT = ("array<struct<period:double,power:double,depth:double,depth_err:double,snr:double,"
          "duration:double,epoch:double,n_in:bigint>>")


def search_input(points: DataFrame, *, value: str, cell_days: float, keys: list[str] | None = None) -> DataFrame:
    """One row per series: its time cells, totals, scatter and span. The cell list is bounded by span/cell."""
    keys = keys or ["series_id"]
    x = points.filter(F.col(value).isNotNull())
    cells = x.groupBy(*keys, F.floor(F.col("t") / cell_days).alias("_cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col(value) * SCALE).cast("bigint")).alias("s"),
        F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    packed = cells.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(((F.col("_cell") + 0.5) * cell_days).alias("t"), "n", "s"))).alias("cells"),
        F.sum("n").alias("n_total"), F.sum("s").alias("s_total"), F.min("_t0").alias("t_first"), F.max("_t1").alias("t_last"))
    sigma = grouped_mad(x, keys, F.col(value), median="centre", scatter="sigma")
    return packed.join(sigma, keys)


def linear_steps(lo: Column, hi: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: lo + (hi - lo) * i / (n - 1)


def log_steps(lo: Column, hi: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: lo * F.pow(hi / lo, i / (n - 1))


def linear_grid(lo: Column, hi: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), linear_steps(lo, hi, n))


def log_grid(lo: Column, hi: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), log_steps(lo, hi, n))


def _best_boxes(t, n, s, n_total, s_total, sigma, periods, durations, oversample):
    """Best box of each trial period, one array per field (power 0 where there is none); phase bins of all periods lie in one flat array."""
    periods = np.asarray(periods, dtype=float)
    order = np.sort(np.asarray(durations, dtype=float))
    nb = np.maximum(np.ceil(periods / (order[0] / oversample)), 1).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(nb)[:-1]))
    turns = t[None, :] / periods[:, None]
    b = np.minimum(((turns - np.floor(turns)) * nb[:, None]).astype(np.int64), nb[:, None] - 1) + start[:, None]
    size = int(nb.sum())
    pid = np.repeat(np.arange(len(periods)), nb)
    i = np.arange(size) - start[pid]
    # Each period's bins lie there twice, so a box past the last bin is one range as well.
    at = np.arange(size) + start[pid]
    twice = np.concatenate((at, at + nb[pid]))

    def prefix(w):
        x = np.bincount(b.ravel(), np.tile(w, len(periods)), size).astype(np.int64)
        both = np.empty(2 * size, np.int64)
        both[twice] = np.concatenate((x, x))
        return np.concatenate(([0], np.cumsum(both)))

    pre_n, pre_s = prefix(n), prefix(s)
    low_n, low_s = pre_n[at], pre_s[at]
    best = np.zeros(len(periods))
    pick = [np.full(len(periods), np.nan) for _ in range(5)]
    for d in order:
        k = np.maximum(np.floor(d * nb / periods + 0.5), 1).astype(np.int64)
        stop = at + np.repeat(np.minimum(k, nb), nb)
        n_in = pre_n[stop] - low_n
        s_in = pre_s[stop] - low_s
        n_out = n_total - n_in
        with np.errstate(divide="ignore", invalid="ignore"):
            depth = ((s_total - s_in) / n_out - s_in / n_in) / SCALE
            good = (n_in > 0) & (n_out > 0) & (depth > 0) & np.repeat(k < nb, nb)
            power = np.where(good, 0.5 * n_in * depth * depth / (sigma * sigma), -1.0)
        top = np.maximum.reduceat(power, start)
        better = np.flatnonzero(top > best)
        if not len(better):
            continue
        # The first bin with the greatest power of each period.
        hits = np.flatnonzero(power == np.repeat(top, nb))[::-1]
        won = np.empty(len(periods), np.int64)
        won[pid[hits]] = hits
        won = won[better]
        best[better] = top[better]
        found = (depth[won], sigma * np.sqrt(1.0 / np.maximum(n_in[won], 1) + 1.0 / np.maximum(n_out[won], 1)), d,
                 (i[won] + k[better] / 2) / nb[better] * periods[better], n_in[won])
        for old, new in zip(pick, found):
            old[better] = new
    depth, err, d, epoch, n_in = pick
    return periods, best, depth, err, depth / err, d, epoch, n_in


def _search_one(t, n, s, n_total, s_total, sigma, periods, durations, oversample):
    """``_best_boxes`` as rows; what has no box is null."""
    columns = _best_boxes(t, n, s, n_total, s_total, sigma, periods, durations, oversample)
    return [(*r[:7], int(r[7])) if r[1] > 0 else (r[0], 0.0) + (None,) * 6 for r in zip(*columns)]


FIELDS = ("period", "power", "depth", "depth_err", "snr", "duration", "epoch", "n_in")


def _blocks(cells: int, periods: np.ndarray, finest: float) -> list[np.ndarray]:
    """Cut trial periods so that neither period x cell nor the phase bins of a block pass ``BLOCK``."""
    cost = np.maximum(cells, np.ceil(periods / finest))
    block = np.floor((np.cumsum(cost) - cost) / BLOCK)
    return np.split(periods, np.flatnonzero(np.diff(block)) + 1)


def box_search(inputs: DataFrame, jobs: DataFrame, *, oversample: int, keys: list[str] | None = None, tasks: int | None = None,
               steps: Callable[[Column], Column] | None = None, n: int | None = None, work: int = WORK, chunk: int | None = None) -> DataFrame:
    """Best box per (job, trial period); ``idx`` is the period's index in its job.

    ``jobs`` has the series keys, ``durations`` (days), ``periods`` and any further columns to
    carry; it may be ``inputs`` itself with these columns added. A long grid is given as ``steps`` and ``n`` instead of ``periods`` and is made after
    the rows have moved. ``chunk`` bounds the periods of a row further. Series whose scatter is
    not positive give no rows.
    """
    keys = keys or ["series_id"]

    def search(t: pd.Series, n: pd.Series, s: pd.Series, n_total: pd.Series, s_total: pd.Series, sigma: pd.Series,
               periods: pd.Series, durations: pd.Series) -> pd.Series:
        out = []
        for t1, n1, s1, nt, st, sg, ps, ds in zip(t, n, s, n_total, s_total, sigma, periods, durations):
            t1, n1, s1 = np.asarray(t1), np.asarray(n1, dtype=float), np.asarray(s1, dtype=float)
            blocks = _blocks(len(t1), np.asarray(ps, dtype=float), min(ds) / oversample)
            out.append([dict(zip(FIELDS, r)) for block in blocks for r in _search_one(t1, n1, s1, int(nt), int(st), sg, block, ds, oversample)])
        return pd.Series(out)

    carried = [c for c in jobs.columns if c in keys or c not in ("periods", "durations", *inputs.columns)]
    cells = inputs.filter("sigma > 0").select(*keys, "cells", "n_total", "s_total", "sigma")
    x = jobs.filter("sigma > 0") if "cells" in jobs.columns else jobs.join(cells, keys)
    size = F.lit(n) if steps else F.size("periods")
    parts = F.greatest(F.lit(1), F.ceil(F.size("cells") * size.cast("double") / work), *([F.ceil(size / chunk)] if chunk else []))
    x = x.withColumn("_parts", F.least(parts, size).cast("bigint")).filter("_parts > 0")
    x = x.withColumn("_part", F.explode(F.expr("sequence(0L, _parts - 1)")))
    # A fixed number of tasks: rows are small and slow, so merging partitions by size would cost parallelism.
    tasks = tasks or int(inputs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = x.repartition(tasks, *keys, *[c for c in carried if c not in keys], "_part")
    edge = lambda part: F.floor(size * part / F.col("_parts")).cast("int")
    x = x.withColumns({"_from": edge(F.col("_part")), "_to": edge(F.col("_part") + 1)})
    own = F.transform(F.expr("sequence(_from, _to - 1)"), steps) if steps else F.expr("slice(periods, _from + 1, _to - _from)")
    found = F.pandas_udf(search, RESULT)("cells.t", "cells.n", "cells.s", "n_total", "s_total", "sigma", "_own", "durations")
    x = x.withColumn("_own", own).select(*carried, "_from", F.posexplode(found).alias("_pos", "_r"))
    return x.select(*carried, (F.col("_from") + F.col("_pos")).cast("bigint").alias("idx"), "_r.*")


def grid_search(inputs: DataFrame, *, periods: tuple[float, float, int], durations: list[float], oversample: int,
                spacing: str = "linear", work: int = WORK, chunk: int | None = None) -> DataFrame:
    """Search every series on one grid; add the index and the population z-score of the power."""
    lo, hi, n = periods
    steps = (linear_steps if spacing == "linear" else log_steps)(F.lit(lo), F.lit(hi), n)
    jobs = inputs.withColumn("durations", F.array(*[F.lit(d) for d in durations]))
    return with_sde(box_search(inputs, jobs, oversample=oversample, steps=steps, n=n, work=work, chunk=chunk))


def periodogram(points: DataFrame, *, value: str, periods: tuple[float, float, int], durations: list[float], oversample: int,
                cell_days: float, spacing: str = "linear", work: int = WORK, chunk: int | None = None) -> DataFrame:
    """``grid_search`` of points."""
    inputs = search_input(points, value=value, cell_days=cell_days)
    return grid_search(inputs, periods=periods, durations=durations, oversample=oversample, spacing=spacing, work=work, chunk=chunk)


def with_sde(pg: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add ``sde``, the population z-score of the power within each series."""
    keys = keys or ["series_id"]
    w = Window.partitionBy(*keys)  # a grid is bounded per series, and the search then runs once
    return pg.withColumn("sde", F.try_divide(F.col("power") - F.avg("power").over(w), F.stddev_pop("power").over(w)))


def _running_median_z(size: int):
    def score(powers: pd.Series) -> pd.Series:
        half, out = size // 2, []
        for y in powers:
            y = np.asarray(y, dtype=float)
            padded = np.pad(y, half, mode="symmetric")
            windows = np.lib.stride_tricks.sliding_window_view(padded, size)
            r = y - np.concatenate([np.median(w, axis=1) for w in np.array_split(windows, max(1, len(y) // 2000))])
            std = r.std()
            out.append((r - r.mean()) / std if std > 0 else np.full(len(y), np.nan))
        return pd.Series(out)
    return score


def running_median_sde(pg: DataFrame, *, size: int) -> DataFrame:
    """z-score of the power over a reflected running median; a grid is a bounded array per series."""
    grid = pg.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("idx", "period", "power"))).alias("_g"))
    z = F.pandas_udf(_running_median_z(size), "array<double>")(F.col("_g.power"))
    x = grid.select("series_id", F.arrays_zip(F.col("_g"), z.alias("z")).alias("_z")).select("series_id", F.explode("_z").alias("_r"))
    return x.select("series_id", F.col("_r._g.idx").alias("idx"), F.col("_r._g.period").alias("period"), F.nanvl("_r.z", F.lit(None).cast("double")).alias("sde"))


def log_bin_sde(pg: DataFrame, *, bins: int, lo: float, hi: float, min_size: int) -> DataFrame:
    """z-score of the power within bins of equal log period; null in a sparse bin."""
    band = F.least(F.floor(F.log(F.col("period") / lo) / F.log(F.lit(hi / lo)) * bins), F.lit(bins - 1))
    x = pg.withColumn("band", band.cast("bigint"))
    w = Window.partitionBy("series_id", "band")
    z = F.when(F.count(F.lit(1)).over(w) >= min_size, F.try_divide(F.col("power") - F.avg("power").over(w), F.stddev_pop("power").over(w)))
    return x.select("series_id", "idx", "band", z.alias("sde"))
