"""The period index of signals against every pair, and windows against every point."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasemill.operators import identity


def signals(seed, n, lo=0.3, hi=40.0, series=2):
    rng = np.random.default_rng(seed)
    period = np.exp(rng.uniform(np.log(lo), np.log(hi), n))
    # Near copies at a ratio of half of the signals, so that every kind of pair occurs.
    m = rng.choice([1.0, 0.25, 1 / 3, 0.5, 2.0, 3.0, 4.0], n // 2)
    period[n // 2:n // 2 * 2] = period[:n // 2] * m * (1 + rng.normal(size=n // 2) * 10.0 ** rng.uniform(-6, -1, n // 2))
    return pd.DataFrame({"series_id": rng.integers(0, series, n), "cid": np.arange(n), "period": period, "epoch": rng.uniform(-5, 35, n),
                         "duration": rng.uniform(0.05, 3.0, n), "depth": 0.01, "score": rng.integers(0, 4, n).astype(float)})


@pytest.mark.parametrize("tolerance", [0.1, 0.5, 2.0])
def test_index_finds_every_direct_pair_and_every_ratio(spark, tolerance):
    a, b = spark.createDataFrame(signals(1, 240)), spark.createDataFrame(signals(2, 240))
    b = b.unionByName(a.limit(60).withColumn("cid", F.col("cid") + 1000))
    key = lambda df: sorted((r.series_id, r.a_cid, r.b_cid, r.dist, tuple(r.multipliers)) for r in df.collect())
    every = identity.pairs(a, b, 0.0, 27.0, tolerance)
    want = key(every.filter(F.col("direct") | (F.size("multipliers") > 0)))
    assert key(identity.near_pairs(a, b, 0.0, 27.0, tolerance)) == want
    assert any(w[4] for w in want) and any(w[3] <= tolerance for w in want)


def test_a_series_with_very_many_signals_is_not_paired_with_itself(spark):
    n = 20_000
    x = spark.range(n).select(F.lit(1).alias("series_id"), F.col("id").alias("cid"), (0.5 * F.pow(F.lit(1.0003), F.col("id"))).alias("period"), F.lit(1.0).alias("epoch"),
                              F.lit(0.01).alias("duration"), F.lit(0.01).alias("depth"), F.lit(1.0).alias("score"))
    y = x.withColumn("cid", F.col("cid") + n)
    got = identity.lifecycle(x, y, 0.0, 27.0, 0.5).groupBy("action", "reason").count().collect()
    assert sum(r["count"] for r in got) >= n


def test_shared_points_equal_a_look_at_every_point(spark):
    rng = np.random.default_rng(5)
    s = signals(3, 40, hi=9.0).assign(duration=rng.uniform(0.05, 6.0, 40))  # wider than some periods
    obs = pd.DataFrame({"series_id": rng.integers(0, 2, 300), "t": np.r_[rng.uniform(-3, 30, 299), -3.0]})
    a = spark.createDataFrame(s)
    p = identity.pairs(a, a, 0.0, 27.0, 0.5).filter("a_cid < b_cid")
    got = {(r.series_id, r.a_cid, r.b_cid): (r.shared, r.either) for r in identity.shared_points(p, spark.createDataFrame(obs)).collect()}
    inside = lambda t, r: np.abs((t - r.epoch + r.period / 2) % r.period - r.period / 2) < r.duration / 2
    want = {}
    for x in s.itertuples():
        for y in s.itertuples():
            if x.cid < y.cid and x.series_id == y.series_id:
                t = obs.t[obs.series_id == x.series_id].to_numpy()
                i, j = inside(t, x), inside(t, y)
                if (i | j).any():
                    want[x.series_id, x.cid, y.cid] = (int((i & j).sum()), int((i | j).sum()))
    assert got == want


def test_representative_names_the_smallest_of_the_best_and_its_tie(spark):
    rows = [(1, 4, 2.0), (1, 3, 2.0), (1, 1, 1.0), (2, 9, 5.0), (2, 8, 1.0), (3, 1, 0.0)]
    got = identity.representative(spark.createDataFrame(rows, "series_id int, cid bigint, score double")).collect()
    assert {(r.series_id, r.representative, r.tie) for r in got} == {(1, 3, True), (2, 9, False), (3, 1, False)}


def test_harmonic_pairs_equal_a_look_at_every_pair(spark):
    from phasemill.operators.iterate import harmonic_duplicate
    a, b = spark.createDataFrame(signals(6, 160)), spark.createDataFrame(signals(7, 160))
    multiples = [0.25, 0.5, 1.0, 2.0, 4.0]
    hit = harmonic_duplicate("b_period", "b_duration", F.lit(3), "a_period", "a_duration", multiples)
    key = lambda df: sorted((r.series_id, r.a_cid, r.b_cid, r.dist) for r in df.filter(hit).collect())
    want = key(identity.pairs(a, b, 0.0, 27.0, 0.5))
    assert want and key(identity.harmonic_pairs(a, b, multiples, 3, 0.0, 27.0, 0.5)) == want
