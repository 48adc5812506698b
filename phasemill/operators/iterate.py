"""Iterative search and removal over all series at once, as a state machine in tables.

The state is the accepted models; points are never rewritten, but divided by the
models of their series as they are read. Each round searches the series that are
still active, walks down their peaks past those that repeat an accepted signal (before
or after refinement), gates the first other one, divides it out and checks what is
left. Every step is a row with its measurements, and each series ends with one row of
status ``terminated``. Rounds are few and fixed; their tables are checkpointed, so a
lost executor repeats a part of one round at most.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasemill.functions.phase import box_factor, cycle, in_window
from phasemill.operators import boxsearch as bs
from phasemill.operators import models as mo
from phasemill.operators import peaks as pk
from phasemill.session import cut_lineage

MAX_DURATION_FRACTION = 0.35
ALIASES = (0.5, 1.0, 2.0)
#: Trial periods of the refinement (over two grid steps to both sides) and of the local power (over 2 %), and durations.
REFINE_PERIODS, REFINE_DURATIONS, LOCAL_PERIODS, LOCAL_SPAN = 201, 15, 201, 0.02


@dataclass(frozen=True)
class RemovalLimits:
    power_ratio: float = 0.5
    edge_excess: float = 1.5
    other_log2: float = 1.0
    overlap: float = 3.0
    offset_z: float = 5.0
    offset_rel: float = 0.1


def harmonic_duplicate(period: str, duration: str, transits: Column, other_period: str, other_duration: str, multiples=ALIASES) -> Column:
    """|P - m Pc| * N <= max(D, Dc) / 2 for some multiple m."""
    reach = F.greatest(duration, other_duration) / 2
    return reduce(lambda a, b: a | b, [F.abs(F.col(period) - m * F.col(other_period)) * transits <= reach for m in multiples])


def removal_failures(limits: RemovalLimits = RemovalLimits()) -> Column:
    """Names of the removal checks that fail, in fixed order, from the columns of ``removal_measures``. What cannot be measured fails."""
    beyond = lambda c, most: F.coalesce(F.col(c) > most, F.lit(False))
    z, rel = F.abs("window_offset_z"), F.abs("window_offset_rel")
    return F.array_compact(F.array(
        F.when(F.col("n_finite_residual") != F.col("n_valid_input"), "non_finite"),
        F.when(~F.coalesce(F.col("power_ratio") <= limits.power_ratio, F.lit(False)), "power_not_reduced"),
        F.when(beyond("edge_excess", limits.edge_excess), "edge_excess"),
        F.when(F.col("n_others_measured") < F.col("n_others"), "other_depth_not_measurable"),
        F.when(beyond("other_depth_log2_max", limits.other_log2), "other_candidate_damaged"),
        F.when(beyond("overlap_dev", limits.overlap), "overlap_distortion"),
        F.when(F.col("edge_excess").isNull() | F.col("window_offset_z").isNull(), "qa_not_measurable"),
        F.when((z > limits.offset_z) & ~F.coalesce(rel <= limits.offset_rel, F.lit(False)), "window_offset")))


def local_power(inputs: DataFrame, models: DataFrame, keys: list[str], *, oversample: int, rel: float = LOCAL_SPAN, n: int = LOCAL_PERIODS) -> DataFrame:
    """(keys, local_power): the largest power within ``rel`` of each model's period, at its own duration."""
    p = F.col("period")
    jobs = models.select(*keys, bs.linear_grid(p * (1 - rel), p * (1 + rel), n).alias("periods"), F.array("duration").alias("durations"))
    return bs.box_search(inputs, jobs, oversample=oversample).groupBy(*keys).agg(F.max("power").alias("local_power"))


def removal_measures(points: DataFrame, models: DataFrame, *, oversample: int, cell_days: float, min_points: int) -> DataFrame:
    """(series_id, measures): what dividing out each series' one new model leaves behind.

    ``points`` is (series_id, t, v0, v): the value as it came in and after the accepted
    models; ``models`` is (series_id, period, epoch, duration, depth, others) with the
    accepted models as a list (one per earlier round, so a handful). The depths of the
    others are taken from the value as it came in, with and without the new model.
    """
    key = ["series_id"]
    mine = box_factor("t", F.col("period"), F.col("epoch"), F.col("duration"), F.col("depth"))
    x = points.join(models, key).withColumn("_f", mine)
    x = cut_lineage(x.withColumns({"r": F.when(F.col("_f") > 0, F.col("v") / F.col("_f")), "r0": F.when(F.col("_f") > 0, F.col("v0") / F.col("_f"))}).drop("_f"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    counts = x.groupBy(*key).agg(F.count_if(finite("v")).alias("n_valid_input"), F.count_if(finite("r")).alias("n_finite_residual"))
    left = mo.residual_quality(x, key, value="r").select("series_id", "edge_excess", "offset", F.col("offset_z").alias("window_offset_z"))
    covered = F.exists("others", lambda m: in_window("t", m["period"], m["epoch"], m["duration"]))
    lap = mo.overlap(x, key, covered, value="r")
    # Each other model's window over the same points; sums leave the map side per (series, model).
    other = x.select("series_id", "t", "v0", "r0", F.posexplode("others").alias("_k", "_m"))
    inside = in_window("t", F.col("_m.period"), F.col("_m.epoch"), F.col("_m.duration"))
    depth = lambda c: F.avg(F.when(~inside, F.col(c))) - F.avg(F.when(inside, F.col(c)))
    depths = other.groupBy("series_id", "_k").agg(depth("v0").alias("_a"), depth("r0").alias("_b"), F.count("r0").alias("_n"))
    good = F.coalesce((F.col("_a") > 0) & (F.col("_b") > 0) & (F.col("_n") >= min_points), F.lit(False))
    depths = depths.groupBy(*key).agg(F.count_if(good).alias("n_others_measured"), F.max(F.when(good, F.abs(F.log2("_a") - F.log2("_b")))).alias("other_depth_log2_max"))
    before = local_power(bs.search_input(x, value="v", cell_days=cell_days), models, key, oversample=oversample).withColumnRenamed("local_power", "power_before")
    rest = bs.search_input(x, value="r", cell_days=cell_days).filter(F.col("n_total") >= min_points)
    after = local_power(rest, models, key, oversample=oversample).withColumnRenamed("local_power", "power_after")
    out = models.select("series_id", F.size("others").alias("n_others"), F.col("depth").alias("_depth"))
    for part in (counts, left, lap, depths, before, after):
        out = out.join(part, key, "left")
    return out.fillna(0, ["n_others_measured"]).withColumns({
        "power_ratio": F.when(F.col("power_before") > 0, F.col("power_after") / F.col("power_before")), "window_offset_rel": F.col("offset") / F.col("_depth")}).select(
        "series_id", "n_valid_input", "n_finite_residual", "power_before", "power_after", "power_ratio", "edge_excess", "n_others", "n_others_measured",
        "other_depth_log2_max", "overlap_fraction", "overlap_dev", "window_offset_z", "window_offset_rel")


def _transits(points: DataFrame, peaks: DataFrame) -> DataFrame:
    """Add the observed events; the peaks of a series travel as one list of five at most, so a point is read once."""
    packed = peaks.groupBy("series_id").agg(F.collect_list(F.struct("rank", "period", "epoch", "duration")).alias("_p"))
    near = points.select("series_id", "t").join(packed, "series_id").select("series_id", "t", F.explode("_p").alias("_q"))
    near = near.filter(in_window("t", F.col("_q.period"), F.col("_q.epoch"), F.col("_q.duration")))
    seen = near.groupBy("series_id", F.col("_q.rank").alias("rank")).agg(F.count_distinct(cycle("t", F.col("_q.period"), F.col("_q.epoch"))).alias("n_transits"))
    return peaks.join(seen, ["series_id", "rank"], "left").fillna(0, ["n_transits"])


_FOUND = ["period", "epoch", "duration", "depth", "depth_err", "snr", "power"]


def refined(inputs: DataFrame, points: DataFrame, peaks: DataFrame, *, spacing: float, least_period: float, oversample: int, n: int = REFINE_PERIODS,
            n_durations: int = REFINE_DURATIONS) -> DataFrame:
    """Each peak again on a dense grid of periods and durations around it; its own values where no box is found there."""
    most = F.least(F.greatest(2 * F.col("duration"), F.lit(0.5)), MAX_DURATION_FRACTION * F.col("period"))
    jobs = peaks.select("series_id", "rank", bs.linear_grid(F.greatest(F.col("period") - 2 * spacing, F.lit(least_period)), F.col("period") + 2 * spacing, n).alias("periods"),
                        bs.linear_grid(F.least(0.5 * F.col("duration"), most), most, n_durations).alias("durations"))
    best = bs.box_search(inputs, jobs, oversample=oversample).filter("power > 0").groupBy("series_id", "rank").agg(
        F.max_by(F.struct(*_FOUND), F.struct("power", -F.col("period"))).alias("_b"))
    again = peaks.join(best, ["series_id", "rank"], "left").withColumn("_b", F.coalesce("_b", F.struct(*_FOUND)))
    again = again.select("series_id", "rank", "sde", F.col("period").alias("period_coarse"), *[F.col(f"_b.{c}").alias(c) for c in _FOUND])
    return _transits(points, again)


def _with_duplicates(peaks: DataFrame, accepted: DataFrame | None) -> DataFrame:
    """Add ``duplicate_of_step``, the first accepted step that a peak repeats; null for a new one."""
    if accepted is None:
        return peaks.withColumn("duplicate_of_step", F.lit(None).cast("int"))
    prior = accepted.select("series_id", "step", F.col("period").alias("_p"), F.col("duration").alias("_d"))
    # Five peaks and five accepted signals a series at most.
    hit = peaks.join(prior, "series_id").filter(harmonic_duplicate("period", "duration", F.greatest("n_transits", F.lit(1)), "_p", "_d"))
    return peaks.join(hit.groupBy("series_id", "rank").agg(F.min("step").alias("duplicate_of_step")), ["series_id", "rank"], "left")


def iterate(points: DataFrame, *, periods: tuple[float, float, int], durations: list[float], oversample: int, cell_days: float,
            snr_min: float = 7.0, sde_min: float = 6.0, transits_min: int = 2, min_points: int = 100, rounds: int = 5, n_peaks: int = 5,
            limits: RemovalLimits = RemovalLimits()) -> DataFrame:
    """The steps of every series with their measurements, and one row of status ``terminated`` each.

    ``points`` is ``(series_id, part_id, seq, t, v)`` with v near 1. Statuses: accepted,
    rejected_duplicate, rejected_gate, qa_failed, error, terminated.
    """
    lo, hi, n = periods
    spacing = (hi - lo) / max(n - 1, 1)
    original = cut_lineage(points.filter(F.col("v").isNotNull()).withColumn("v0", F.col("v")))
    active: DataFrame | None = None
    accepted: DataFrame | None = None
    steps: list[DataFrame] = []

    def end(df: DataFrame, step: int, reason: str | Column) -> None:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        steps.append(df.select("series_id", F.lit(step).alias("step"), F.lit("terminated").alias("status"), reason.alias("reason")))

    def note(df: DataFrame, step: int, status: str, reason: str = "") -> None:
        steps.append(df.withColumns({"step": F.lit(step), "status": F.lit(status), "reason": F.lit(reason)}).drop("n_others", "n_others_measured"))

    for step in range(rounds + 1):
        current = original if active is None else original.join(active, "series_id", "left_semi")
        if accepted is not None:
            packed = mo.packed_models(accepted, order="step")
            current = current.join(packed, "series_id").withColumn("v", F.try_divide("v0", mo.product_of(F.col("models"), F.col("t")))).drop("models")
        if step == rounds:
            sizes = current.groupBy("series_id").agg(F.count("v").alias("_n"))
            end(sizes, step, F.when(F.col("_n") < min_points, "insufficient_observations").otherwise("max_iterations_reached"))
            break
        inputs = cut_lineage(bs.search_input(current, value="v", cell_days=cell_days))
        end(inputs.filter(F.col("n_total") < min_points), step, "insufficient_observations")
        inputs = inputs.filter(F.col("n_total") >= min_points)
        end(inputs.filter("NOT sigma > 0"), step, "numerical_failure")
        inputs = inputs.filter("sigma > 0")
        pg = cut_lineage(bs.grid_search(inputs, periods=periods, durations=durations, oversample=oversample))
        top = pk.greedy_peaks(pg.filter("power > 0"), ["series_id"], n_peaks, pk.relative_clash(0.02))
        top = _transits(current, top.select("series_id", "rank", "idx").join(pg, ["series_id", "idx"]))
        top = cut_lineage(_with_duplicates(top, accepted).select("series_id", "rank", "sde", "n_transits", "duplicate_of_step", *_FOUND))
        known = top.filter("duplicate_of_step IS NOT NULL").withColumn("period_coarse", F.col("period"))
        waiting = top.filter("duplicate_of_step IS NULL").drop("duplicate_of_step", "n_transits")
        # The best peak that is new; refinement may show that it repeats a signal, then the next one is tried.
        chosen: DataFrame | None = None
        for attempt in range(n_peaks):
            first = waiting.groupBy("series_id").agg(F.min("rank").alias("rank"))
            pick = refined(inputs, current, waiting.join(first, ["series_id", "rank"]), spacing=spacing, least_period=lo, oversample=oversample)
            pick = cut_lineage(_with_duplicates(pick, accepted))
            new = pick.filter("duplicate_of_step IS NULL").drop("duplicate_of_step")
            chosen = new if chosen is None else chosen.unionByName(new)
            again = pick.filter("duplicate_of_step IS NOT NULL")
            if accepted is None or not again.limit(1).count():
                break
            known = known.unionByName(again)
            waiting = cut_lineage(waiting.join(again.select("series_id"), "series_id", "left_semi").join(again.select("series_id", "rank"), ["series_id", "rank"], "left_anti"))
        chosen = cut_lineage(chosen)
        passed_by = known.join(chosen.select("series_id", F.col("rank").alias("_r")), "series_id", "left").filter(F.col("_r").isNull() | (F.col("rank") < F.col("_r"))).drop("_r")
        note(passed_by, step, "rejected_duplicate")
        none = inputs.select("series_id").join(chosen, "series_id", "left_anti").join(top.select("series_id").distinct().withColumn("_any", F.lit(True)), "series_id", "left")
        end(none, step, F.when(F.col("_any"), "duplicate_or_harmonic_only").otherwise("no_quality_peak"))
        sound = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in ("period", "epoch", "duration", "depth", "depth_err", "snr", "sde", "power")])
        sound = F.coalesce(sound & (F.col("depth_err") > 0) & (F.col("depth") > 0) & (F.col("depth") < 1) & (F.col("duration") > 0) & (F.col("duration") < F.col("period")), F.lit(False))
        gate = (F.col("snr") >= snr_min) & (F.col("sde") >= sde_min) & (F.col("n_transits") >= transits_min) & (F.col("duration") <= MAX_DURATION_FRACTION * F.col("period"))
        note(chosen.filter(~sound), step, "error", "candidate_validation_failed")
        end(chosen.filter(~sound), step, "candidate_validation_failed")
        note(chosen.filter(sound & ~gate), step, "rejected_gate", "no_quality_peak")
        end(chosen.filter(sound & ~gate), step, "no_quality_peak")
        good = cut_lineage(chosen.filter(sound & gate))
        others = good.select("series_id", F.array().cast("array<struct<step:int,period:double,epoch:double,duration:double,depth:double>>").alias("others"))
        if accepted is not None:
            others = good.select("series_id").join(mo.packed_models(accepted, order="step").withColumnRenamed("models", "others"), "series_id")
        models = good.select("series_id", *mo.MODEL).join(others, "series_id")
        measures = removal_measures(current.select("series_id", "t", "v0", "v"), models, oversample=oversample, cell_days=cell_days, min_points=min_points)
        judged = cut_lineage(good.join(measures, "series_id").withColumn("qa_failures", F.concat_ws(",", removal_failures(limits))))
        note(judged.filter("qa_failures <> ''"), step, "qa_failed", "removal_qa_failed")
        end(judged.filter("qa_failures <> ''"), step, "removal_qa_failed")
        passed = judged.filter("qa_failures = ''").withColumn("step", F.lit(step))
        active = passed.select("series_id")
        accepted = cut_lineage(passed if accepted is None else accepted.unionByName(passed))
        if not active.limit(1).count():
            break

    # Signals are measured again on the series as it came in.
    sigma = bs.search_input(original, value="v0", cell_days=cell_days).select("series_id", "sigma")
    again = original.join(accepted.select("series_id", "step", "period", "epoch", "duration"), "series_id")
    again = mo.fixed_depth(again, ["series_id", "step"], sigma, value="v0").select("series_id", "step", F.col("fit_snr").alias("original_snr"))
    held = F.coalesce(F.col("original_snr") >= snr_min, F.lit(False))
    signals = accepted.drop("n_others", "n_others_measured").join(again, ["series_id", "step"], "left").withColumn("status", F.lit("accepted"))
    signals = signals.withColumn("reason", F.when(held, "validated_on_original").otherwise("candidate_validation_failed"))
    lost = signals.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"), F.bool_and(held).alias("_held")).filter("NOT _held")
    steps.append(lost.select("series_id", F.col("_n").cast("int").alias("step"), F.lit("error").alias("status"), F.lit("candidate_validation_failed").alias("reason")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [signals, *steps])
