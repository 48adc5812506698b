"""Identity of signals: pairing, review, lifecycle and labels.

Pairs are found through an index by log period: every signal asks the cells its
partners' periods can lie in, at ratio 1 and at each review ratio, and exact
distances are computed behind it. So a series with very many signals spreads over its
cells and is never paired with itself as a whole; only ``pairs`` lists every pair, where
that is the question. Nothing here pairs across series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasemill.functions.ephemeris import REVIEW_MULTIPLIERS, alias_multipliers, distance
from phasemill.functions.phase import in_window
from phasemill.operators.rangejoin import point_join
from phasemill.session import cut_lineage

SIGNAL = ("period", "epoch", "duration", "depth", "score")
#: Width of an index cell in log period, and what rounding may move a bound by.
CELL, SLACK = 0.02, 1e-9


def strongest(df: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The ``count`` best rows per key. Spark limits each map task's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "cid")
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= count).drop("_rank")


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("series_id", *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != "series_id"])


def _measured(x: DataFrame, start: float, end: float, tolerance: float) -> DataFrame:
    s, e = F.lit(start), F.lit(end)
    return (x.withColumn("dist", distance("a_", "b_", s, e)).withColumn("multipliers", alias_multipliers("a_", "b_", s, e, tolerance))
            .withColumn("direct", F.col("dist") <= tolerance))


def pairs(a: DataFrame, b: DataFrame, start: float, end: float, tolerance: float) -> DataFrame:
    """Every pair of a series' two signal lists with its distance and alias ratios: for reports that list all of them."""
    return _measured(_side(a, "a_").join(_side(b, "b_"), "series_id"), start, end, tolerance)


def probe_join(a: DataFrame, b: DataFrame, spans: list[tuple[Column, Column]], *, cell: float = CELL) -> DataFrame:
    """Pairs in which b's period lies in the same index cells as one of the ``spans`` over a's columns.

    Both have prefixed columns; a pair comes once. The key is (series, cell). It is a candidate list:
    the caller's exact test decides.
    """
    at = lambda p: F.floor(F.log(p) / cell).cast("bigint")
    low = F.lit(1e-12)
    cells = [F.sequence(at(F.greatest(lo * (1 - SLACK), low)), at(F.greatest(hi * (1 + SLACK), low))) for lo, hi in spans]
    x = a.filter("a_period > 0").withColumn("_cell", F.explode(F.array_distinct(F.concat(*cells))))
    y = b.filter("b_period > 0").withColumn("_cell", at(F.col("b_period")))
    return x.join(y, ["series_id", "_cell"]).drop("_cell")


def near_pairs(a: DataFrame, b: DataFrame, start: float, end: float, tolerance: float) -> DataFrame:
    """The rows of ``pairs`` that are direct or have an alias ratio, without making the others.

    Trains that stay together differ by at most tolerance x duration over the cycles between the
    event in the middle and the farther end, which are one at least and cover half the interval:
    |P - Q| <= tolerance x D x min(1, 2 P / span). For a ratio the cycles cover the whole interval.
    """
    p, allowed, span = F.col("a_period"), tolerance * F.col("a_duration"), end - start
    around = lambda q, w: (q - w, q + w)
    one = lambda q, share: F.least(F.lit(1.0), share * q / span)
    spans = [around(p, allowed * one(p, 2.0))]
    for m in REVIEW_MULTIPLIERS:
        spans.append(around(m * p, allowed * F.greatest(m * one(p, 1.0), one(m * p, 1.0))))
    x = _measured(probe_join(_side(a, "a_"), _side(b, "b_"), spans), start, end, tolerance)
    return x.filter(F.col("direct") | (F.size("multipliers") > 0))


def harmonic_pairs(a: DataFrame, b: DataFrame, multiples: list[float], transits: int, start: float, end: float, tolerance: float) -> DataFrame:
    """Measured pairs whose periods agree at one of the multiples within half the longer duration over ``transits`` events.

    The side with the longer duration asks the index, so the reach it asks with is its own.
    """
    p, reach = F.col("a_period"), F.col("a_duration") / (2 * transits)
    left = probe_join(_side(a, "a_"), _side(b, "b_"), [(m * p - reach, m * p + reach) for m in multiples]).filter("a_duration >= b_duration")
    right = probe_join(_side(b, "a_"), _side(a, "b_"), [((p - reach) / m, (p + reach) / m) for m in multiples]).filter("a_duration > b_duration")
    swap = {"a_": "b_", "b_": "a_"}
    right = right.select(*[F.col(c).alias(swap.get(c[:2], c[:2]) + c[2:]) for c in right.columns])
    return _measured(left.unionByName(right), start, end, tolerance)


def degrees(edges: DataFrame) -> DataFrame:
    """Add how many direct edges each side of an edge has."""
    a, b = Window.partitionBy("series_id", "a_cid"), Window.partitionBy("series_id", "b_cid")
    return edges.withColumns({"deg_a": F.count(F.lit(1)).over(a), "deg_b": F.count(F.lit(1)).over(b)})


def reconcile(old: DataFrame, new: DataFrame, start: float, end: float, tolerance: float, *, paired: DataFrame | None = None) -> DataFrame:
    """Per series: resolved with matches, additions and retirements, or held as ambiguous or possible_alias."""
    p = paired if paired is not None else cut_lineage(near_pairs(old, new, start, end, tolerance))
    edges = degrees(p.filter("direct"))
    amb = edges.groupBy("series_id").agg(F.bool_or((F.col("deg_a") > 1) | (F.col("deg_b") > 1)).alias("amb"), F.count(F.lit(1)).alias("n_edges"))
    ma, mb = edges.select("series_id", "a_cid").distinct().withColumn("_ma", F.lit(True)), edges.select("series_id", "b_cid").distinct().withColumn("_mb", F.lit(True))
    open_pairs = p.join(ma, ["series_id", "a_cid"], "left").join(mb, ["series_id", "b_cid"], "left").filter(F.col("_ma").isNull() | F.col("_mb").isNull())
    alias = open_pairs.groupBy("series_id").agg(F.bool_or(F.size("multipliers") > 0).alias("alias"))
    sizes = (old.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_old")).join(new.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_new")), "series_id", "full_outer"))
    x = sizes.join(amb, "series_id", "left").join(alias, "series_id", "left").fillna(0, ["n_old", "n_new", "n_edges"])
    status = F.when(F.col("amb"), "ambiguous").when(F.col("alias"), "possible_alias").otherwise("resolved")
    ok = F.col("status") == "resolved"
    n = lambda c: F.when(ok, c).otherwise(F.lit(0))
    return x.withColumn("status", status).select("series_id", "status", n(F.col("n_edges")).alias("matched"), n(F.col("n_new") - F.col("n_edges")).alias("added"),
                                                 n(F.col("n_old") - F.col("n_edges")).alias("retired"))


def lifecycle(old: DataFrame, new: DataFrame, start: float, end: float, tolerance: float) -> DataFrame:
    """One action per signal: keep, add or retire; every signal of a held series is held with the reason."""
    p = cut_lineage(near_pairs(old, new, start, end, tolerance))
    verdict = reconcile(old, new, start, end, tolerance, paired=p).select("series_id", "status")
    edges = p.filter("direct").select("series_id", F.col("a_cid").alias("old_cid"), F.col("b_cid").alias("new_cid"))
    kept = edges.withColumn("action", F.lit("keep"))
    gone = old.select("series_id", F.col("cid").alias("old_cid")).join(edges.select("series_id", "old_cid"), ["series_id", "old_cid"], "left_anti").withColumn("action", F.lit("retire"))
    added = new.select("series_id", F.col("cid").alias("new_cid")).join(edges.select("series_id", "new_cid"), ["series_id", "new_cid"], "left_anti").withColumn("action", F.lit("add"))
    x = kept.unionByName(gone, True).unionByName(added, True).join(verdict, "series_id")
    held = F.col("status") != "resolved"
    return x.select("series_id", "old_cid", "new_cid", F.when(held, "hold").otherwise(F.col("action")).alias("action"), F.when(held, F.col("status")).alias("reason")).distinct()


def review(signals: DataFrame, start: float, end: float, tolerance: float) -> DataFrame:
    """Pairs of one series' signals that overlap or may be aliases; never merged here."""
    p = near_pairs(signals, signals, start, end, tolerance).filter("a_cid < b_cid")
    return p.withColumn("relation", F.when(F.col("direct"), "direct_overlap").otherwise("possible_alias"))


def representative(signals: DataFrame) -> DataFrame:
    """The strongest signal of each series and whether another one ties with it."""
    # Per distinct score first: the count at the top combines on the map side.
    at = signals.groupBy("series_id", "score").agg(F.min("cid").alias("cid"), F.count(F.lit(1)).alias("n"))
    top = at.groupBy("series_id").agg(F.max_by(F.struct("cid", "n"), "score").alias("r"))
    return top.select("series_id", F.col("r.cid").alias("representative"), (F.col("r.n") > 1).alias("tie"))


def exact_groups(signals: DataFrame) -> DataFrame:
    """Copies of one model: equal parameters, epochs apart by whole cycles."""
    turns = F.col("epoch") / F.col("period")
    base = F.col("epoch") - F.floor(turns) * F.col("period")
    return signals.groupBy("series_id", "period", "duration", "depth", base.alias("base_epoch")).agg(
        F.min("cid").alias("representative"), (F.count(F.lit(1)) - 1).alias("duplicates"))


def _events(near: DataFrame, spans: DataFrame, side: str) -> DataFrame:
    """One row per pair and event of one side within the series' points."""
    p, e = F.col(f"{side}_period"), F.col(f"{side}_epoch")
    nth = lambda t: F.floor((t - e) / p + 0.5).cast("bigint")
    x = near.join(spans, "series_id").withColumn("_k", F.explode(F.sequence(nth(F.col("_first")), nth(F.col("_last")))))
    half = F.least(F.col(f"{side}_duration"), p) / 2 * (1 + SLACK) + SLACK  # in_window decides the edge
    centre = e + F.col("_k") * p
    return x.withColumns({"_side": F.lit(side), "_lo": centre - half, "_hi": centre + half})


def shared_points(near: DataFrame, obs: DataFrame) -> DataFrame:
    """Observed points in both windows and in either, for the pairs that are near enough to need it.

    Events of the pairs meet the points in time cells, so a point meets only the windows it may lie in;
    counts combine on the map side. Pairs without a point in a window give no row.
    """
    near = near.select("series_id", "a_cid", "b_cid", *[f"{s}_{c}" for s in "ab" for c in ("period", "epoch", "duration")])
    spans = obs.groupBy("series_id").agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    events = _events(near, spans, "a").unionByName(_events(near, spans, "b"))
    inside = {s: in_window("t", F.col(f"{s}_period"), F.col(f"{s}_epoch"), F.col(f"{s}_duration")) for s in "ab"}
    own = F.when(F.col("_side") == "a", F.struct(F.col("a_period").alias("p"), F.col("a_epoch").alias("e"))).otherwise(F.struct(F.col("b_period").alias("p"), F.col("b_epoch").alias("e")))
    # A point belongs to its nearest event, so wide windows that overlap count it once.
    nearest = F.floor((F.col("t") - own["e"]) / own["p"] + 0.5) == F.col("_k")
    hits = point_join(obs.select("series_id", "t"), events, ["series_id"], "t", "_lo", "_hi", 1.0, nearest & (inside["a"] | inside["b"]))
    first, both = F.col("_side") == "a", inside["a"] & inside["b"]
    return hits.groupBy("series_id", "a_cid", "b_cid").agg(
        F.count_if(first & both).alias("shared"),
        (F.count_if(first & inside["a"]) + F.count_if(~first & inside["b"]) - F.count_if(first & both)).alias("either"))


def match_external(ours: DataFrame, external: DataFrame, obs: DataFrame, start: float, end: float, *, tolerance: float = 0.5,
                   ratio_max: float = 2.0, shared_min: int = 1, jaccard_min: float = 0.5) -> DataFrame:
    """Status of every external signal: direct_match, ambiguous_match, possible_alias or external_only."""
    p = cut_lineage(near_pairs(ours, external, start, end, tolerance))  # read for edges and for aliases
    ratio = F.greatest("a_duration", "b_duration") / F.least("a_duration", "b_duration")
    near = p.filter(F.col("direct") & (ratio <= ratio_max))
    seen = shared_points(near, obs)
    edges = degrees(seen.filter((F.col("shared") >= shared_min) & (F.col("shared") / F.col("either") >= jaccard_min)))
    amb = edges.groupBy("series_id", "b_cid").agg(F.bool_or((F.col("deg_a") > 1) | (F.col("deg_b") > 1)).alias("amb"), F.min("a_cid").alias("match"))
    alias = p.join(edges.select("series_id", "a_cid", "b_cid"), ["series_id", "a_cid", "b_cid"], "left_anti").filter(F.size("multipliers") > 0).select("series_id", "b_cid").distinct().withColumn("alias", F.lit(True))
    x = external.select("series_id", F.col("cid").alias("b_cid")).join(amb, ["series_id", "b_cid"], "left").join(alias, ["series_id", "b_cid"], "left")
    status = F.when(F.col("amb"), "ambiguous_match").when(F.col("amb").isNotNull(), "direct_match").when(F.col("alias"), "possible_alias").otherwise("external_only")
    return x.select("series_id", F.col("b_cid").alias("external_id"), status.alias("status"), F.when(~F.col("amb"), F.col("match")).alias("candidate_id"))
