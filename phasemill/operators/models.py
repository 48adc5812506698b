"""Box event models: evaluation, removal and the statistics of a fixed ephemeris.

A model row is ``(period, epoch, duration, depth)`` in days and relative flux.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasemill.functions.phase import box_factor, cycle, in_window, phase_distance
from phasemill.operators.medians import grouped_mad, grouped_median
from phasemill.operators.sizing import small

MODEL = ("period", "epoch", "duration", "depth")


def packed_models(models: DataFrame, *, order: str = "model_id") -> DataFrame:
    """The models of a series as one ordered array; a series has a handful."""
    return models.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(order, *MODEL))).alias("models"))


def product_of(models: Column, t: Column) -> Column:
    """Product of the model curves in stored order; 1 for an empty list."""
    return F.aggregate(models, F.lit(1.0), lambda acc, m: acc * box_factor(t, m.period, m.epoch, m.duration, m.depth))


def with_model(obs: DataFrame, models: DataFrame) -> DataFrame:
    """Add ``model``, the combined curve at each observation."""
    return (obs.join(small(packed_models(models)), "series_id", "left")
            .withColumn("model", F.coalesce(product_of(F.col("models"), F.col("t")), F.lit(1.0))).drop("models"))


def remove_models(obs: DataFrame, models: DataFrame, *, value: str = "v") -> DataFrame:
    """Add ``residual`` and the series' ``removal_status``; a non-positive model fails the series."""
    x = with_model(obs, models)
    bad = x.groupBy("series_id").agg(F.bool_or((F.col("model") <= 0) & F.col(value).isNotNull()).alias("_bad"))
    x = x.join(bad, "series_id")
    return (x.withColumn("removal_status", F.when(F.col("_bad"), "nonpositive_model").otherwise("ok"))
            .withColumn("residual", F.when(~F.col("_bad"), F.col(value) / F.col("model"))).drop("_bad"))


def window_class(*, edge: bool = True) -> Column:
    """inside (< D/2), edge (< D) or out (>= D) of the nearest event."""
    d = F.abs(phase_distance("t", F.col("period"), F.col("epoch")))
    inner = F.when(d < F.col("duration") / 2, "inside")
    return (inner.when(d < F.col("duration"), "edge") if edge else inner).otherwise("out")


def fixed_depth(points: DataFrame, keys: list[str], sigma: DataFrame, *, value: str) -> DataFrame:
    """Depth, error and SNR of each fixed ephemeris; points carry the model columns."""
    inside = in_window("t", F.col("period"), F.col("epoch"), F.col("duration"))
    x = points.groupBy(*keys).agg(
        F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_out"),
        F.avg(F.when(inside, F.col(value))).alias("_in"), F.avg(F.when(~inside, F.col(value))).alias("_out"))
    x = x.join(sigma, "series_id").withColumn("fit_depth", F.col("_out") - F.col("_in")).withColumn(
        "fit_err", F.col("sigma") * F.sqrt(F.try_divide(F.lit(1.0), F.col("n_in")) + F.try_divide(F.lit(1.0), F.col("n_out"))))
    return x.withColumn("fit_snr", F.try_divide("fit_depth", "fit_err")).drop("_in", "_out")


def residual_quality(points: DataFrame, keys: list[str], *, value: str, min_inside: int = 5, min_out: int = 20) -> DataFrame:
    """Edge excess and window offset of a residual: how much signal a removal left behind.

    ``edge_excess`` is the median |r-1| in the edge band over the outside scatter;
    ``offset_z`` the mean r-1 inside over scatter/sqrt(n). Null where too few points.
    """
    x = points.withColumn("_cls", window_class())
    y = F.col(value)
    counts = x.groupBy(*keys).agg(
        F.count_if(F.col("_cls") == "inside").alias("n_in"), F.count_if(F.col("_cls") == "edge").alias("n_edge"), F.count_if(F.col("_cls") == "out").alias("n_out"),
        F.avg(F.when(F.col("_cls") == "inside", y - 1)).alias("mean_in"), F.avg(F.when(F.col("_cls") == "out", y - 1)).alias("mean_out"))
    scatter = grouped_mad(x.filter("_cls = 'out'"), keys, y, median="_med", scatter="_sc").drop("_med")
    edge = grouped_median(x.filter("_cls = 'edge'"), keys, F.abs(y - 1), "_edge")
    x = counts.join(scatter, keys, "left").join(edge, keys, "left")
    sc = F.when(F.col("_sc") > 0, F.col("_sc"))
    wide = (F.col("n_out") >= min_out)
    return x.select(
        *keys, "n_in", "n_edge", "n_out",
        F.when(wide & (F.col("n_edge") >= min_inside), F.col("_edge") / sc).alias("edge_excess"),
        F.when(wide & (F.col("n_in") >= min_inside), F.col("mean_in")).alias("offset"),
        F.when(wide & (F.col("n_in") >= min_inside), F.col("mean_in") / (sc / F.sqrt("n_in"))).alias("offset_z"),
        F.when(wide & (F.col("n_in") >= min_inside), (F.col("mean_in") - F.col("mean_out")) / (sc * F.sqrt(1 / F.col("n_in") + 1 / F.col("n_out")))).alias("offset_z_out"))


def overlap(points: DataFrame, keys: list[str], others: Column, *, value: str) -> DataFrame:
    """Share of a model's in-window points that other models cover, and their deviation over the whole scatter."""
    mine = in_window("t", F.col("period"), F.col("epoch"), F.col("duration"))
    x = points.withColumns({"_mine": mine, "_both": mine & F.coalesce(others, F.lit(False))})
    head = x.groupBy(*keys).agg(F.count_if("_mine").alias("n_mine"), F.count_if("_both").alias("n_both"))
    dev = grouped_median(x.filter("_both"), keys, F.abs(F.col(value) - 1), "_dev")
    sc = grouped_mad(x, keys, F.col(value), median="_m", scatter="_sc").drop("_m")
    x = head.join(dev, keys, "left").join(sc, keys, "left")
    return x.select(*keys, F.coalesce(F.try_divide("n_both", "n_mine"), F.lit(0.0)).alias("overlap_fraction"),
                    F.when((F.col("n_both") >= 3) & (F.col("_sc") > 0), F.col("_dev") / F.col("_sc")).alias("overlap_dev"))


def parity_depths(points: DataFrame, keys: list[str], *, value: str) -> DataFrame:
    """Median depth in the primary, secondary, odd and even windows against the outside median."""
    dist = phase_distance("t", F.col("period"), F.col("epoch"))
    half = F.col("duration") / 2
    primary = F.abs(dist) < half
    secondary = F.abs(F.abs(dist) - F.col("period") / 2) < half
    odd = F.pmod(F.rint((F.col("t") - F.col("epoch")) / F.col("period")), F.lit(2.0)) == 1
    cls = F.when(primary & odd, "odd").when(primary, "even").when(secondary, "secondary").otherwise("outside")
    x = points.withColumn("_cls", cls)
    parts = grouped_median(x, keys + ["_cls"], F.col(value), "_m").groupBy(*keys).pivot("_cls", ["odd", "even", "secondary", "outside"]).agg(F.first("_m"))
    whole = grouped_median(x.filter(F.col("_cls").isin("odd", "even")), keys, F.col(value), "_primary")
    scatter = grouped_mad(x.filter("_cls = 'outside'"), keys, F.col(value), median="_o", scatter="outside_scatter").drop("_o")
    x = parts.join(whole, keys, "left").join(scatter, keys, "left")
    d = lambda c: F.col("outside") - F.col(c)
    return x.select(*keys, d("_primary").alias("primary_depth"), d("secondary").alias("secondary_depth"), d("odd").alias("odd_depth"),
                    d("even").alias("even_depth"), "outside_scatter")


def cycle_depths(points: DataFrame, keys: list[str], *, value: str) -> DataFrame:
    """Secondary depth of each cycle against the baseline next to it."""
    centre = F.col("epoch") + F.col("period") / 2
    k = F.rint((F.col("t") - centre) / F.col("period"))
    delta = F.abs(F.col("t") - (centre + k * F.col("period")))
    half = F.col("duration") / 2
    x = points.withColumn("cyc", k.cast("bigint")).withColumn("_cls", F.when(delta < half, "in").when((delta >= 2 * half) & (delta < 4 * half), "out"))
    keys = keys + ["cyc"]
    counts = x.groupBy(*keys).agg(F.count_if(F.col("_cls") == "in").alias("n_in"), F.count_if(F.col("_cls") == "out").alias("n_base"))
    # One cycle of one series holds period/cadence points: bounded by the instrument.
    med = grouped_median(x.filter("_cls IS NOT NULL"), keys + ["_cls"], F.col(value), "_m", bounded=True).groupBy(*keys).pivot("_cls", ["in", "out"]).agg(F.first("_m"))
    return counts.join(med, keys, "left").select(*keys, "n_in", "n_base", (F.col("out") - F.col("in")).alias("depth"))


def local_depth(points: DataFrame, keys: list[str], *, value: str, min_points: int = 3) -> DataFrame:
    """Median just outside the event minus the median inside."""
    d = F.abs(phase_distance("t", F.col("period"), F.col("epoch")))
    cls = F.when(d < F.col("duration") / 2, "in").when((d >= F.col("duration")) & (d < F.least(2 * F.col("duration"), F.col("period") / 2)), "out")
    x = points.withColumn("_cls", cls).filter("_cls IS NOT NULL")
    counts = x.groupBy(*keys).agg(F.count_if(F.col("_cls") == "in").alias("n_in"), F.count_if(F.col("_cls") == "out").alias("n_out"))
    med = grouped_median(x, keys + ["_cls"], F.col(value), "_m").groupBy(*keys).pivot("_cls", ["in", "out"]).agg(F.first("_m"))
    ok = (F.col("n_in") >= min_points) & (F.col("n_out") >= min_points)
    return counts.join(med, keys, "left").select(*keys, "n_in", "n_out", F.when(ok, F.col("out") - F.col("in")).alias("depth"))


def joint_depths(points: DataFrame, keys: list[str], a: Column, b: Column, *, value: str) -> DataFrame:
    """Least-squares depths of two windows and a baseline, from the sums of the four window cells.

    The design has only four distinct rows (a, b, both, outside), so counts, sums
    and sums of squares determine the fit: one aggregate per pair, no matrix of points.
    """
    y = F.col(value)
    x = points.withColumns({"_a": a, "_b": b})
    A, B = F.col("_a"), F.col("_b")
    g = x.groupBy(*keys).agg(
        F.count_if(A & ~B).alias("a_only"), F.count_if(B & ~A).alias("b_only"), F.count_if(A & B).alias("both"), F.count_if(~A & ~B).alias("outside"),
        F.sum(y).alias("_y"), F.sum(F.when(A, y)).alias("_ya"), F.sum(F.when(B, y)).alias("_yb"), F.sum(y * y).alias("_yy"))
    n = (F.col("a_only") + F.col("b_only") + F.col("both") + F.col("outside")).cast("double")
    na, nb, nab = F.col("a_only") + F.col("both"), F.col("b_only") + F.col("both"), F.col("both")
    # Centred normal equations: [saa sab; sab sbb] (da db) = -(say sby).
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    g = g.withColumns({"_saa": na - na * na / n, "_sbb": nb - nb * nb / n, "_sab": nab - na * nb / n,
                       "_say": zero("_ya") - na * F.col("_y") / n, "_sby": zero("_yb") - nb * F.col("_y") / n, "_syy": F.col("_yy") - F.col("_y") * F.col("_y") / n, "_n": n})
    det = F.col("_saa") * F.col("_sbb") - F.col("_sab") * F.col("_sab")
    g = g.withColumn("_det", det)
    ok = (F.col("outside") > 0) & (F.col("_n") >= 4) & (F.col("_det") > 1e-9 * F.greatest(F.col("_saa") * F.col("_sbb"), F.lit(1e-9)))
    da = -(F.col("_say") * F.col("_sbb") - F.col("_sby") * F.col("_sab")) / F.col("_det")
    db = -(F.col("_sby") * F.col("_saa") - F.col("_say") * F.col("_sab")) / F.col("_det")
    g = g.withColumns({"depth_a": F.when(ok, da), "depth_b": F.when(ok, db)})
    rss = F.greatest(F.col("_syy") + F.col("depth_a") * F.col("_say") + F.col("depth_b") * F.col("_sby"), F.lit(0.0))
    var = rss / F.when(F.col("_n") > 3, F.col("_n") - 3)
    g = g.withColumns({"err_a": F.sqrt(var * F.col("_sbb") / F.col("_det")), "err_b": F.sqrt(var * F.col("_saa") / F.col("_det"))})
    status = F.when((F.col("outside") == 0) | (F.col("_n") < 4), "not_measurable").when(~ok, "unidentifiable").otherwise("measured")
    return g.select(*keys, "a_only", "b_only", "both", "outside", status.alias("status"), "depth_a", "depth_b", "err_a", "err_b")
