"""Peaks of a periodogram: maxima, greedy selection, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasemill.operators.cleaning import interpolated


def local_maxima(df: DataFrame, keys: list[str], index: str, value: str, *, strict: bool = False) -> DataFrame:
    """Strictly above the left neighbour, not below the right one, above at least one.

    ``strict`` wants both neighbours and the row above both: no edge and no plateau.

    A grid is bounded per key, so one window per key is bounded too.
    """
    w = Window.partitionBy(*keys).orderBy(index)
    y, left, right = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    x = df.withColumns({"_left": left, "_right": right})
    left, right = F.col("_left"), F.col("_right")
    if strict:
        return x.filter((y > left) & (y > right)).drop("_left", "_right")
    above = F.coalesce(y > left, F.lit(False)) | F.coalesce(y > right, F.lit(False))
    return x.filter(y.isNotNull() & (left.isNull() | (y > left)) & (right.isNull() | (y >= right)) & above).drop("_left", "_right")


def scaled_view(keys: DataFrame, cells: DataFrame, *, bins: int) -> DataFrame:
    """Fill empty bins by interpolation, centre on the median, scale the deepest bin to -1."""
    spine = keys.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    x = spine.join(cells, ["series_id", "bin"], "left")
    w = Window.partitionBy("series_id").orderBy("bin")
    row = F.when(F.col("med").isNotNull(), F.struct("bin", "med"))
    lo, hi = F.last(row, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(row, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumns({"_lo": lo, "_hi": hi}).select("series_id", "bin", F.col("_lo.bin").alias("lt"), F.col("_lo.med").alias("ly"),
                                                     F.col("_hi.bin").alias("ht"), F.col("_hi.med").alias("hy"))
    x = x.withColumn("y", interpolated("lt", "ly", "ht", "hy", "bin"))
    whole = Window.partitionBy("series_id")
    x = x.withColumn("z", F.col("y") - F.percentile("y", F.lit(0.5)).over(whole))
    return x.select("series_id", "bin", F.try_divide("z", F.abs(F.min("z").over(whole))).alias("y"))


def greedy_peaks(grid: DataFrame, keys: list[str], count: int, clash, *, cols: tuple[str, ...] = ("idx", "period", "power")) -> DataFrame:
    """Take points by descending power, skipping any that ``clash(candidate, chosen)`` with one already taken.

    A grid is bounded per key, so its points fit one array; the selection is a fold over it.
    """
    rows = F.array_sort(F.collect_list(F.struct((-F.col("power")).alias("_o"), *cols)))
    packed = grid.filter(F.col("power").isNotNull()).groupBy(*keys).agg(rows.alias("_rows"))
    taken = F.aggregate("_rows", F.slice("_rows", 1, 0),
                        lambda acc, x: F.when((F.size(acc) < count) & ~F.exists(acc, lambda c: clash(x, c)), F.concat(acc, F.array(x))).otherwise(acc))
    out = packed.select(*keys, F.posexplode(taken).alias("_pos", "_p"))
    return out.select(*keys, (F.col("_pos") + 1).alias("rank"), *[F.col(f"_p.{c}").alias(c) for c in cols])


def relative_clash(separation: float):
    """Periods closer than ``separation``, relative to the chosen one."""
    return lambda x, c: F.abs(x.period / c.period - 1) < separation


def frequency_clash(baseline: float | Column):
    """Frequencies closer than the resolution 1/baseline."""
    return lambda x, c: F.abs(1 / x.period - 1 / c.period) < 1 / (F.lit(baseline) if isinstance(baseline, float) else baseline)


def cell_clash(half_cells: int, multiples: tuple[float, ...], lo: float, hi: float, n: int, *, slack: float = 1e-9):
    """Closer than ``2h+1`` cells, or a multiple of the chosen period within reach of the candidate (linear grid)."""
    at = lambda i: lo + (hi - lo) * i / (n - 1)

    def clash(x, c):
        low, high = at(F.greatest(x.idx - half_cells, F.lit(0))), at(F.least(x.idx + half_cells, F.lit(n - 1)))
        out = F.abs(x.idx - c.idx) < 2 * half_cells + 1
        for m in multiples:
            target = c.period * m
            out = out | ((target >= low - target * slack) & (target <= high + target * slack))
        return out

    return clash


def quality_gate(snr: str, sde: str, transits: Column | None = None, *, snr_min: float = 7.0, sde_min: float = 6.0, transits_min: int = 2) -> tuple[Column, Column]:
    """Status and reasons of a peak: failed, held or accepted."""
    bad = ~(F.coalesce(F.abs(F.col(snr)) < float("inf"), F.lit(False)) & F.coalesce(F.abs(F.col(sde)) < float("inf"), F.lit(False)))
    few = F.lit(False) if transits is None else transits < transits_min
    held = F.array_compact(F.array(F.when(F.col(snr) < snr_min, "snr_below_threshold"), F.when(F.col(sde) < sde_min, "sde_below_threshold"),
                                   F.when(few, "insufficient_transits")))
    reasons = F.when(bad, F.array(F.lit("non_finite_metric"))).otherwise(held)
    return F.when(bad, "failed").when(F.size(held) > 0, "held").otherwise("accepted"), reasons
