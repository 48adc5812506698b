"""Engagement, cohort and evaluation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasemill.functions.scalars import json_strings
from phasemill.operators.medians import grouped_median
from phasemill.operators.ordered import latest

MATCHES = ("matched", "matched_harmonic")
CHECKS = ("oddeven", "secondary", "ushape")
METRIC_UNITS = {"firstMatchAccuracy": "PERCENT", "submissionsPerStar": "SUBMISSIONS_PER_STAR", "harmonicRecognitionRate": "PERCENT",
                "evidencePerSubmission": "CHECKS_PER_SUBMISSION"}


def agrees() -> Column:
    """The judgement agrees with the truth of the signal."""
    return F.coalesce(((F.col("truth") == "planet") & (F.col("judgment") == "LIKELY"))
                      | ((F.col("truth") == "not_planet") & (F.col("judgment") == "UNLIKELY")), F.lit(False))


def ratio(numerator: str, denominator: str, scale: float = 100.0) -> list[Column]:
    """Value (null on a zero denominator) and its status."""
    value = F.try_divide(F.col(numerator) * scale, F.col(denominator))
    return [F.round(value, 6).alias("value"), F.when(F.col(denominator) == 0, "NO_SAMPLE").otherwise("AVAILABLE").alias("status")]


def first_matches(subs: DataFrame) -> DataFrame:
    """Earliest match of each member and signal."""
    return latest(subs.filter(F.col("match_result").isin(*MATCHES)), ["user_id", "candidate_id"], ["created_at", "id"], first=True)


def graded_first_matches(subs: DataFrame, dispositions: DataFrame) -> DataFrame:
    d = dispositions.filter("answer_class = 'graded'").select("candidate_id", "truth")
    return first_matches(subs).join(d, "candidate_id").withColumn("agrees", agrees())


def votes(subs: DataFrame, keys: list[str]) -> DataFrame:
    """Latest judgement per key."""
    return latest(subs, keys, ["created_at", "id"], keep=keys + ["judgment"])


def member_metrics(members: DataFrame, subs: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Agreement, activity, recognition and evidence counts of every member, zero where there is none.

    ``subs`` carry their ``kind`` and the JSON list ``checks``; only candidate submissions count evidence, each
    check of ``CHECKS`` once a submission. A signal is recognised once, by its earliest match.
    """
    first = first_matches(subs).join(dispositions.select("candidate_id", "truth", "answer_class"), "candidate_id", "left")
    graded = F.coalesce(F.col("answer_class") == "graded", F.lit(False))
    found = first.groupBy("user_id").agg(F.count_if(graded & agrees()).alias("agreed"), F.count_if(graded).alias("graded"),
                                         F.count(F.lit(1)).alias("recognized"), F.count_if(F.col("match_result") == "matched_harmonic").alias("harmonic"))
    named = F.size(F.array_intersect(F.coalesce(json_strings(F.col("checks")), F.array().cast("array<string>")), F.array(*[F.lit(c) for c in CHECKS])))
    candidate = F.col("kind") == "candidate"
    activity = subs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("submissions"), F.count_distinct("star_id").alias("stars"), F.count_if(candidate).alias("candidates"),
        F.coalesce(F.sum(F.when(candidate, named).cast("bigint")), F.lit(0)).alias("evidence"))
    return members.select("user_id").join(found, "user_id", "left").join(activity, "user_id", "left").fillna(0)


def metric_rows(metrics: DataFrame) -> DataFrame:
    """One row per member and metric; the value is null where the denominator is zero."""
    part = lambda name, num, den, scale: F.struct(F.lit(name).alias("metric"), F.try_divide(F.col(num) * scale, F.col(den)).alias("value"))
    rows = F.array(part("firstMatchAccuracy", "agreed", "graded", 100.0), part("submissionsPerStar", "submissions", "stars", 1.0),
                   part("harmonicRecognitionRate", "harmonic", "recognized", 100.0), part("evidencePerSubmission", "evidence", "candidates", 1.0))
    return metrics.select("user_id", F.explode(rows).alias("m")).select("user_id", "m.*")


def active_cohort(members: DataFrame, subs: DataFrame, start: Column, end: Column) -> DataFrame:
    """Active members with a submission from ``start`` up to but not at ``end``."""
    seen = subs.filter((F.col("created_at") >= start) & (F.col("created_at") < end)).select("user_id").distinct()
    return members.filter("status = 'active'").select("user_id").join(seen, "user_id", "left_semi")


def cohort_medians(rows: DataFrame) -> DataFrame:
    """Exact median of each metric over the members that have it, one row per metric also without a member."""
    units = rows.sparkSession.createDataFrame(list(METRIC_UNITS.items()), "metric string, unit string")
    sizes = rows.groupBy("metric").agg(F.count(F.lit(1)).alias("n_cohort"), F.count("value").alias("n_members"))
    x = units.join(sizes, "metric", "left").fillna(0, ["n_cohort", "n_members"])
    x = x.join(grouped_median(rows, "metric", F.col("value"), "median"), "metric", "left")
    return x.withColumn("status", F.when(F.col("n_members") == 0, "NO_SAMPLE").otherwise("AVAILABLE"))


def kpi_counts(df: DataFrame, named: list[tuple[str, str, Column, Column | None]]) -> DataFrame:
    """One aggregate over ``df``, turned into (key, unit, numerator, denominator) rows."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    aggs = [zero(c).alias(f"{side}{i}") for i, (_, _, num, den) in enumerate(named) for side, c in (("n", num), ("d", den)) if c is not None]
    rows = [F.struct(F.lit(key).alias("key"), F.lit(unit).alias("unit"), F.col(f"n{i}").alias("numerator"),
                     (F.lit(None).cast("bigint") if den is None else F.col(f"d{i}")).alias("denominator")) for i, (key, unit, _, den) in enumerate(named)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def kpi_values(rows: DataFrame, unknown: tuple[str, ...] = ()) -> DataFrame:
    """Add value, status and reason; rates are per cent, and keys in ``unknown`` carry their reason."""
    n, d = F.col("numerator"), F.col("denominator")
    empty = F.coalesce(d == 0, F.lit(False))
    value = F.when(d.isNull(), n.cast("double")).otherwise(F.try_divide(n * 100.0, d))
    reason = F.when(F.col("key").isin(*unknown), F.upper(F.regexp_replace("key", "([a-z])([A-Z])", "$1_$2"))).when(empty, "ZERO_DENOMINATOR")
    return rows.withColumns({"value": F.round(value, 6), "status": F.when(empty, "NO_SAMPLE").otherwise("AVAILABLE"), "reason": reason})


def kpis(pieces: list[tuple[str, DataFrame]]) -> DataFrame:
    """Named one-row counts as (key, value) rows."""
    out = None
    for key, df in pieces:
        row = df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(key).alias("key"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def precision_recall(scores: DataFrame, *, score: str = "score", positive: str = "positive") -> DataFrame:
    """Curve points at each distinct score, best first.

    Ties are one group. Cumulative counts run over 1,024 bands of the measured range
    of scores first, so no single task sorts all scores, whatever their range.
    """
    g = scores.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("f"))
    low, high = g.agg(F.min("threshold"), F.max("threshold")).head()
    wide = (high - low) if low is not None and high > low else 1.0
    g = g.withColumn("_band", F.floor((F.lit(high).cast("double") - F.col("threshold")) / wide * 1024))
    w = Window.partitionBy("_band").orderBy(F.desc("threshold"))
    bands = g.groupBy("_band").agg(F.sum("p").alias("_p"), F.sum("f").alias("_f"))
    ahead = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)  # at most 1025 bands
    whole = Window.partitionBy()
    bands = bands.select("_band", F.coalesce(F.sum("_p").over(ahead), F.lit(0)).alias("_p0"), F.coalesce(F.sum("_f").over(ahead), F.lit(0)).alias("_f0"),
                         F.sum("_p").over(whole).alias("n_pos"), F.sum("_f").over(whole).alias("n_neg"))
    x = g.join(F.broadcast(bands), "_band")
    tp, fp = F.sum("p").over(w) + F.col("_p0"), F.sum("f").over(w) + F.col("_f0")
    x = x.withColumns({"tp": tp, "fp": fp})
    # The previous point's counts are this point's minus its own group.
    return x.withColumns({"recall": F.try_divide("tp", "n_pos"), "precision": F.col("tp") / (F.col("tp") + F.col("fp")),
                          "prev_recall": F.try_divide(F.col("tp") - F.col("p"), F.col("n_pos")),
                          "prev_precision": F.coalesce(F.try_divide(F.col("tp") - F.col("p"), F.col("tp") + F.col("fp") - F.col("p") - F.col("f")), F.lit(1.0))})


def average_precision(curve: DataFrame) -> DataFrame:
    step = F.col("recall") - F.col("prev_recall")
    return curve.agg(F.max("n_pos").alias("n_positive"), F.max("n_neg").alias("n_negative"), F.round(F.sum(step * F.col("precision")), 8).alias("average_precision"),
                     F.round(F.sum(step * (F.col("precision") + F.col("prev_precision")) / 2), 8).alias("pr_auc_trapezoid"))


def threshold_table(scores: DataFrame, thresholds: list[float], *, score: str = "score", positive: str = "positive") -> DataFrame:
    """Confusion counts per threshold: rows collapse to threshold bands before they meet the list."""
    cuts = F.array(*[F.lit(x) for x in sorted(thresholds)])
    banded = scores.groupBy(F.size(F.filter(cuts, lambda c: c <= F.col(score))).alias("passed")).agg(
        F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("f"))
    x = banded.select("passed", "p", "f", F.posexplode(cuts).alias("i", "threshold"))
    hit = F.col("passed") > F.col("i")
    s = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    return x.groupBy("threshold").agg(s("p", hit).alias("tp"), s("f", hit).alias("fp"), s("p", ~hit).alias("fn"), s("f", ~hit).alias("tn"))
