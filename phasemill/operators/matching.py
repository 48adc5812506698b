"""Matching of submitted selections and injected signals against candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasemill.functions.phase import cycle, in_window
from phasemill.operators.contracts import first_reason
from phasemill.operators.rangejoin import overlap_join, point_join

EPSILON = 1e-9
#: Windows of the index are wider by this much; the exact test of a point follows.
SLACK = 1e-6


def derived_epoch(reference: Column, period: Column, centre: Column, start: Column, end: Column) -> Column:
    """Event nearest the reference inside [start, end], the earlier one on a tie; null when there is none."""
    lo = F.ceil((start - reference) / period - centre)
    hi = F.floor((end - reference) / period - centre)
    # Distance |centre + k| falls until k = -centre: only the bounds and its two neighbours can win.
    k0 = F.floor(-centre)
    pick = lambda k: F.when(hi >= lo, F.least(F.greatest(k, lo), hi))
    at = lambda k: reference + (centre + pick(k)) * period
    a, b = at(k0), at(k0 + 1)
    return F.when(F.abs(b - reference) < F.abs(a - reference) - EPSILON, b).otherwise(a)


def validate(sel: DataFrame, *, min_window: float, width_max: float, period_min: float, period_max: float, judgments: tuple[str, ...]) -> DataFrame:
    """First broken rule of each selection, in rule order."""
    p, a, b = F.col("period"), F.col("phase_start"), F.col("phase_end")
    width = b - a
    return sel.withColumn("rejection", first_reason([
        ("periodDays:VALIDATION_FAILED", ~(p > 0)),
        ("phaseEnd:VALIDATION_FAILED", ~((a >= 0) & (a < 1) & (a < b) & (b < a + 1))),
        ("phaseEnd:MIN_WINDOW", width * p < min_window), ("phaseEnd:PHASE_WIDTH_MAX", width > width_max),
        ("selection:EPOCH_OUT_OF_RANGE", F.col("epoch").isNull()),
        ("userJudgment:VALIDATION_FAILED", F.col("judgment").isNull() | ~F.col("judgment").isin(*judgments)),
        ("periodDays:OUTSIDE_PERIOD_GRID", (p < period_min) | (p > period_max))]))


def event_windows(models: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row per model and event between two times: its number ``k``, ``centre``, and a window ``_lo`` to ``_hi``.

    Rows of one model are bounded by span over period. The window is a little wider than the event; the exact
    test of a point decides its edge.
    """
    x = models.withColumn("k", F.explode(F.sequence(nth_event(first), nth_event(last))))
    half = F.least("duration", "period") / 2 * (1 + SLACK) + SLACK
    x = x.withColumn("centre", F.col("epoch") + F.col("k") * F.col("period"))
    return x.withColumns({"_lo": F.col("centre") - half, "_hi": F.col("centre") + half})


def nth_event(t: Column) -> Column:
    return cycle(t, F.col("period"), F.col("epoch")).cast("bigint")


def event_points(obs: DataFrame, models: DataFrame, *, cell: float = 1.0) -> DataFrame:
    """Each point with every model whose event holds it, and the event's number ``k``.

    Windows meet the points of a series in time cells, so a point meets only the models it may lie in.
    """
    spans = obs.groupBy("series_id").agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    events = event_windows(models.join(spans, "series_id"), F.col("_first"), F.col("_last"))
    # A point belongs to its nearest event, so wide windows that overlap count it once.
    inside = in_window("t", F.col("period"), F.col("epoch"), F.col("duration")) & (nth_event(F.col("t")) == F.col("k"))
    return point_join(obs.select("series_id", "t"), events, ["series_id"], "t", "_lo", "_hi", cell, inside).drop("_first", "_last", "_lo", "_hi", "centre")


def observed_events(candidates: DataFrame, runs: DataFrame, start: float, end: float, *, cell: float = 1.0) -> DataFrame:
    """The parts ``a`` to ``b`` of each candidate's event windows that lie on data, one row per event ``k`` and run.

    Windows meet the runs of a series in time cells; a candidate has at most span over period events, and an
    event without data has no row.
    """
    lo = F.floor((F.lit(start) - F.col("epoch")) / F.col("period")) - 1
    hi = F.ceil((F.lit(end) - F.col("epoch")) / F.col("period")) + 1
    x = candidates.select("series_id", F.col("cid").alias("candidate_id"), "period", "epoch", F.col("duration").alias("c_dur"), F.explode(F.sequence(lo, hi)).alias("k"))
    x = x.withColumn("centre", F.col("epoch") + F.col("k") * F.col("period"))
    x = x.withColumns({"_lo": F.col("centre") - F.col("c_dur") / 2, "_hi": F.col("centre") + F.col("c_dur") / 2})
    met = overlap_join(x, runs.select("series_id", "r0", "r1"), ["series_id"], ("_lo", "_hi"), ("r0", "r1"), cell)
    return met.select("series_id", "candidate_id", "k", "centre", F.greatest("_lo", "r0").alias("a"), F.least("_hi", "r1").alias("b"))


def evaluate(sel: DataFrame, candidates: DataFrame, events: DataFrame, multipliers: list[float], *, min_window: float, ratio_min: float, ratio_max: float,
             min_overlap: int, transits_cap: int | None, id_col: str = "id") -> DataFrame:
    """The four conditions of every (selection, candidate, multiplier).

    ``events`` are the candidates' observed events (see ``observed_events``). Selection ids, and candidate ids
    within a series, are keys. A candidate without data has no observed event and passes nowhere.
    """
    observed = events.groupBy("series_id", "candidate_id").agg(F.count_distinct("k").alias("observed"))
    c = candidates.select("series_id", F.col("cid").alias("candidate_id"), F.col("period").alias("c_period"), F.col("epoch").alias("c_epoch"), F.col("duration").alias("c_dur"))
    c = c.join(observed, ["series_id", "candidate_id"], "left").fillna(0, ["observed"])
    # The selection's own event nearest to each observed one; what they share must lie on data as well.
    mine = F.col("epoch") + F.floor((F.col("centre") - F.col("epoch")) / F.col("period") + 0.5) * F.col("period")
    reach = F.col("width") * F.col("period") / 2
    shared = F.greatest(F.col("a"), mine - reach) <= F.least(F.col("b"), mine + reach)
    hits = sel.select(id_col, "series_id", "period", "epoch", "width").join(events, "series_id").filter(shared)
    overlap = hits.groupBy(id_col, "candidate_id").agg(F.count_distinct("k").alias("overlap"))
    x = sel.join(c, "series_id").join(overlap, [id_col, "candidate_id"], "left").fillna(0, ["overlap"])
    u_dur, half = F.col("width") * F.col("period"), F.greatest(F.col("c_dur") / 2, F.lit(min_window / 2))
    x = x.withColumn("ratio", u_dur / F.col("c_dur"))
    n = F.least(F.col("observed"), F.lit(transits_cap)) if transits_cap else F.col("observed")
    modulus = F.least("period", "c_period")
    off = F.col("epoch") - F.col("c_epoch")
    near = F.floor(off / modulus + 0.5)
    miss = F.least(*[F.abs(off - (near + d) * modulus) for d in (-1, 0, 1)])
    x = x.withColumns({"e_epoch": miss / half, "e_duration": F.abs(F.log2("ratio")), "_n": n, "_half": half})
    x = x.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])))
    x = x.withColumn("e_period", F.abs(F.col("period") * F.col("multiplier") - F.col("c_period")) * F.col("_n") / F.col("_half"))
    ok = (F.col("e_period") <= 1) & (F.col("e_epoch") <= 1) & F.col("ratio").between(ratio_min, ratio_max) & (F.col("overlap") >= min_overlap)
    return x.withColumns({"duration_pass": F.col("ratio").between(ratio_min, ratio_max), "pass": ok,
                          "overlap_ratio": F.coalesce(F.try_divide("overlap", "observed"), F.lit(0.0)), "score": F.greatest("e_period", "e_epoch", "e_duration")}).drop("_n", "_half")


def decide(sel: DataFrame, evals: DataFrame, *, min_gap: float, dominance: float, overlap_tolerance: float, id_col: str = "id") -> DataFrame:
    """Match status of each selection: direct before harmonic, then the score, then the dominance rules."""
    passed = evals.filter("pass")
    # Best direct and best harmonic reading per candidate.
    best = passed.groupBy(id_col, "candidate_id", (F.col("multiplier") == 1).alias("direct")).agg(
        F.min_by(F.struct("score", "overlap_ratio", "multiplier"), F.struct("score", "multiplier")).alias("e")).select(id_col, "candidate_id", "direct", "e.*")
    any_direct = best.groupBy(id_col).agg(F.bool_or("direct").alias("_d"))
    pool = best.join(any_direct, id_col).filter(F.col("direct") == F.col("_d"))
    # Two rows a selection decide it; the group limit cuts the others before they are shuffled.
    order = Window.partitionBy(id_col).orderBy("score", "candidate_id")
    ranked = pool.withColumn("_rank", F.row_number().over(order)).filter("_rank <= 2")
    reading = F.struct("score", "candidate_id", "overlap_ratio", "multiplier")
    top = ranked.groupBy(id_col).agg(*[F.max(F.when(F.col("_rank") == r, reading)).alias(f"_{r}") for r in (1, 2)])
    x = sel.select(id_col).join(top, id_col, "left")
    one, two = F.col("_1"), F.col("_2")
    tie = F.abs(one.score - two.score) <= EPSILON
    bad = tie | ((two.score - one.score) < min_gap) | (one.score > dominance * two.score) | (one.overlap_ratio < two.overlap_ratio - overlap_tolerance)
    won = F.when(one.multiplier == 1, "matched").otherwise("matched_harmonic")
    status = F.when(one.isNull(), "not_matched").when(two.isNull(), won).when(bad, "ambiguous_match").otherwise(won)
    x = x.withColumn("status", status)
    adopted = F.col("status").isin("matched", "matched_harmonic")
    return x.select(id_col, "status", F.when(adopted, one.candidate_id).alias("candidate_id"), F.when(adopted, one.multiplier).alias("multiplier"))


def miss_hints(decided: DataFrame, evals: DataFrame, *, min_overlap: int, ratio_max: float, id_col: str = "id") -> DataFrame:
    """too_wide or too_narrow where only the width kept the best direct reading from matching."""
    close = evals.filter((F.col("multiplier") == 1) & (F.col("e_period") <= 1) & (F.col("e_epoch") <= 1) & (F.col("overlap") >= min_overlap) & ~F.col("duration_pass"))
    best = close.groupBy(id_col).agg(F.min_by("ratio", F.struct("score", "candidate_id")).alias("_r"))
    x = decided.filter("status = 'not_matched'").join(best, id_col)
    return x.select(id_col, F.when(F.col("_r") > ratio_max, "WINDOW_TOO_WIDE").otherwise("WINDOW_TOO_NARROW").alias("hint"))


def injection_grid(series: DataFrame, periods: list[float], durations: list[float], depths: list[float], phases: list[float]) -> DataFrame:
    """One row per series and grid point; ``t_first`` anchors the phase. The grid is a fixed list."""
    def nest(df, name, values):
        return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    x = series
    for name, values in (("period", periods), ("duration", durations), ("depth", depths), ("phase", phases)):
        x = nest(x, name, values)
    return x.withColumn("epoch", F.col("t_first") + F.col("phase") * F.col("period"))


def observed_injections(grid: DataFrame, obs: DataFrame, keys: list[str]) -> DataFrame:
    """Add the observed points and events of each injected signal."""
    inside = event_points(obs, grid.select("series_id", *keys, "period", "epoch", "duration"))
    seen = inside.groupBy("series_id", *keys, "k").agg(F.count(F.lit(1)).alias("_k"))
    counts = seen.groupBy("series_id", *keys).agg(F.count(F.lit(1)).alias("n_transits"), F.sum("_k").alias("n_points"))
    return grid.join(counts, ["series_id", *keys], "left").fillna(0, ["n_transits", "n_points"])


def match_injections(injections: DataFrame, peaks: DataFrame, obs: DataFrame, *, overlap_min: float = 0.5) -> DataFrame:
    """direct, alias_half, alias_double, wrong or missed for each injected signal; direct first, then rank.

    ``injections`` are one per series, ``peaks`` a fixed number per series.
    """
    p = peaks.select("series_id", "rank", F.col("period").alias("p_period"), F.col("epoch").alias("p_epoch"), F.col("duration").alias("p_duration"))
    x = injections.join(p, "series_id", "left")
    # Points of the injected events, of the peaks' events, and of both: no point meets a model away from its events.
    own = event_points(obs, injections.select("series_id", "period", "epoch", "duration")).select("series_id", "t")
    in_a = own.groupBy("series_id").agg(F.count(F.lit(1)).alias("_a"))
    at = p.select("series_id", "rank", F.col("p_period").alias("period"), F.col("p_epoch").alias("epoch"), F.col("p_duration").alias("duration"))
    in_b = event_points(obs, at).groupBy("series_id", "rank").agg(F.count(F.lit(1)).alias("_b"))
    both = own.join(p, "series_id").filter(in_window("t", F.col("p_period"), F.col("p_epoch"), F.col("p_duration"))).groupBy("series_id", "rank").agg(F.count(F.lit(1)).alias("_s"))
    x = x.join(in_a, "series_id", "left").join(in_b, ["series_id", "rank"], "left").join(both, ["series_id", "rank"], "left").fillna(0, ["_a", "_b", "_s"])
    x = x.withColumn("window_overlap", F.try_divide(F.col("_s").cast("double"), F.least("_a", "_b")))
    drift = lambda m: F.abs(F.col("p_period") / m - F.col("period")) * F.greatest("n_transits", F.lit(1)) / (F.col("duration") / 2)
    near = F.coalesce(F.col("window_overlap") >= overlap_min, F.lit(False))
    kind = F.when(near & (drift(1.0) <= 1), "direct").when(near & (drift(0.5) <= 1), "alias_half").when(near & (drift(2.0) <= 1), "alias_double")
    x = x.withColumn("kind", kind)
    order = F.struct(F.when(F.col("kind") == "direct", 0).when(F.col("kind").isNotNull(), 1).otherwise(2), F.when(F.col("kind").isNotNull(), F.col("rank").cast("double")).otherwise(F.abs(F.col("p_period") / F.col("period") - 1)))
    row = F.struct("rank", "kind", "p_period", "window_overlap")
    best = x.groupBy("series_id", "period", "epoch", "duration", "depth").agg(F.min_by(row, order).alias("m"))
    match = F.when(F.col("m.rank").isNull(), "missed").otherwise(F.coalesce("m.kind", F.lit("wrong")))
    return best.select("series_id", "period", "epoch", "duration", "depth", match.alias("match"), F.col("m.rank").alias("matched_rank"), F.col("m.window_overlap").alias("window_overlap"),
                       (F.col("m.p_period") / F.col("period") - 1).alias("period_rel_err"))


def gate_grid(peaks: DataFrame, snr: list[float], sde: list[float], transits: list[int]) -> DataFrame:
    """Surviving peaks for each combination of thresholds: peaks collapse to threshold bands first."""
    lit = lambda vs: F.array(*[F.lit(float(v)) for v in sorted(vs)])
    passed = lambda vs, c: F.size(F.filter(lit(vs), lambda v: v <= F.col(c)))
    bands = peaks.groupBy(passed(snr, "snr").alias("a"), passed(sde, "sde").alias("b"), passed(transits, "n_transits").alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("recovered").alias("r"))
    x = bands.select("*", F.posexplode(lit(snr)).alias("i", "snr_min")).select("*", F.posexplode(lit(sde)).alias("j", "sde_min")).select("*", F.posexplode(lit(transits)).alias("k", "transits_min"))
    hit = (F.col("a") > F.col("i")) & (F.col("b") > F.col("j")) & (F.col("c") > F.col("k"))
    s = lambda c: F.coalesce(F.sum(F.when(hit, F.col(c))), F.lit(0))
    return x.groupBy("snr_min", "sde_min", "transits_min").agg(s("n").alias("survivors"), s("r").alias("recovered"))
