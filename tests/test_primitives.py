"""The skew-safe building blocks against brute force, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasemill.operators import medians
from phasemill.operators.ordered import bracketing, latest, numbered, running_sum, segmented, with_neighbours
from phasemill.operators.rangejoin import overlap_join, point_join
from phasemill.operators.relational import decimate, row_at
from phasemill.operators.statistics import average_precision, precision_recall, threshold_table


def series(n=4000, seed=1):
    rng = np.random.default_rng(seed)
    k = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 20, n))
    return pd.DataFrame({"k": k, "seq": np.arange(n), "t": rng.random(n) * 30, "v": np.round(rng.normal(100, 20, n), 2)})


@pytest.mark.parametrize("accuracy", [20, 500, 100_000])
def test_median_is_exact_for_hot_groups_and_ties(spark, monkeypatch, accuracy):
    # A coarse sketch makes the bracket do real work on small data.
    monkeypatch.setattr(medians, "ACCURACY", accuracy)
    monkeypatch.setattr(medians, "MARGIN", min(10 / accuracy, 0.45))
    p = series()
    p.loc[p.index[:900], "v"] = 77.0
    p = pd.concat([p, pd.DataFrame({"k": [99], "seq": [-1], "t": [0.0], "v": [5.5]})])
    df = spark.createDataFrame(p)
    got = {r.k: r.m for r in medians.grouped_median(df, "k", F.col("v"), "m").collect()}
    want = p.groupby("k").v.median().to_dict()
    assert got == pytest.approx(want, abs=0)
    mad = {r.k: r.scatter for r in medians.grouped_mad(df, "k", F.col("v")).collect()}
    dev = p.groupby("k").v.apply(lambda x: 1.4826 * (x - x.median()).abs().median()).to_dict()
    assert mad == pytest.approx(dev, rel=1e-12)


@pytest.mark.parametrize("few", [100_000, 5])
def test_few_keys_do_not_deal_rows_by_key(spark, monkeypatch, few):
    """Rows of few keys meet their brackets where they lie; of many keys, by a join. The values are the same."""
    monkeypatch.setattr(medians, "FEW", few)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = series()
        out = medians.grouped_mad(spark.createDataFrame(p), "k", F.col("v"))
        got = {r.k: (r.med, r.scatter) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert ("SortMergeJoin" in plan) == (few == 5)
    for k, v in p.groupby("k").v:
        assert got[k] == pytest.approx((v.median(), 1.4826 * (v - v.median()).abs().median()), rel=1e-12)


def test_median_bracket_miss_fails(spark):
    rows = spark.createDataFrame([(1, 5.0, -1, 10), (1, 6.0, 0, 1)], "k int, _v double, _side int, _c bigint")
    with pytest.raises(Exception, match="outside its bracket"):
        medians._middle(rows, ["k"], "m").collect()


def test_ordered_scans(spark):
    p = series().sort_values(["k", "t", "seq"])
    df = spark.createDataFrame(p)
    chunk = F.floor(F.col("t") / 2)
    g = p.groupby("k")
    want = p.assign(prev=g.v.shift(1), nxt=g.v.shift(-1), rn=g.cumcount() + 1, cs=g.seq.cumsum()).set_index("seq")
    x = with_neighbours(df, "k", ["t", "seq"], ["v"], chunk, after=True)
    x = running_sum(numbered(x, "k", ["t", "seq"], chunk, "rn"), "k", ["t", "seq"], F.col("seq"), chunk, "cs").toPandas().set_index("seq").loc[want.index]
    assert np.array_equal(x.rn, want.rn) and np.array_equal(x.cs, want.cs)
    assert np.allclose(x.prev_v, want.prev, equal_nan=True) and np.allclose(x.next_v, want.nxt, equal_nan=True)


@pytest.mark.parametrize("width", [0.5, 3.0, 100.0])
def test_segments_and_positions(spark, width):
    p = series(1500, 3).sort_values(["k", "t", "seq"])
    opens = (p.groupby("k").t.diff() > 0.4).astype(int)
    p["sid"] = opens.groupby(p.k).cumsum()
    p["pos"] = p.groupby(["k", "sid"]).cumcount() + 1
    x = segmented(spark.createDataFrame(p), "k", ["t", "seq"], "t", 0.4, F.floor(F.col("t") / width), position="n").toPandas()
    assert (x.sid == x.segment_id).all() and (x.pos == x.n).all()


def test_bracketing_across_empty_chunks(spark):
    p = series(800, 5).sort_values(["k", "t", "seq"])
    x = bracketing(spark.createDataFrame(p), "k", ["t", "seq"], F.col("seq") % 40 == 0, ["v"], F.floor("t")).toPandas().set_index("seq")
    a = p.assign(a=p.v.where(p.seq % 40 == 0)).set_index("seq")
    assert np.allclose(x.loc[a.index].lo_v, a.groupby("k").a.ffill(), equal_nan=True)
    assert np.allclose(x.loc[a.index].hi_v, a.groupby("k").a.bfill(), equal_nan=True)


def test_latest_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, 5, 10), (1, 5, 11), (1, 4, 12), (2, 1, 1)], "k int, at int, id int")
    assert {(r.k, r.id) for r in latest(df, "k", ["at", "id"]).collect()} == {(1, 11), (2, 1)}
    assert {(r.k, r.id) for r in latest(df, "k", ["at", "id"], first=True).collect()} == {(1, 12), (2, 1)}


def test_range_joins_report_each_pair_once(spark):
    rng = np.random.default_rng(2)
    a = pd.DataFrame({"k": rng.integers(0, 2, 120), "i": range(120), "a0": rng.random(120) * 50})
    b = pd.DataFrame({"k": rng.integers(0, 2, 90), "j": range(90), "b0": rng.random(90) * 50})
    a["a1"], b["b1"] = a.a0 + rng.random(120) * 9, b.b0 + rng.random(90) * 9
    a.loc[0, ["k", "a0", "a1"]] = [0, 10.0, 12.0]
    b.loc[0, ["k", "b0", "b1"]] = [0, 12.0, 14.0]
    m = a.merge(b, on="k")
    want = set(map(tuple, m[(m.a0 <= m.b1) & (m.b0 <= m.a1)][["i", "j"]].values.tolist()))
    rows = [(r.i, r.j) for r in overlap_join(spark.createDataFrame(a), spark.createDataFrame(b), ["k"], ("a0", "a1"), ("b0", "b1"), 4.0).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    pts = spark.createDataFrame(a[["k", "i", "a0"]])
    hit = point_join(pts, spark.createDataFrame(b), ["k"], "a0", "b0", "b1", 3.0, F.col("a0").between(F.col("b0"), F.col("b1")))
    assert {(r.i, r.j) for r in hit.collect()} == set(map(tuple, m[(m.a0 >= m.b0) & (m.a0 <= m.b1)][["i", "j"]].values.tolist()))


def test_row_at_and_decimation(spark):
    df = spark.range(0, 5000).filter("id % 3 = 1").withColumnRenamed("id", "key")
    keys = [i for i in range(5000) if i % 3 == 1]
    for seed in (0, 17, 123456789):
        assert row_at(df, "key", seed, block=64).head().key == keys[seed % len(keys)]
    p = series(700, 9)
    got = decimate(spark.createDataFrame(p), ["k"], ["t", "seq"], F.floor("t"), 15).toPandas()
    for k, g in p.groupby("k"):
        g = g.sort_values(["t", "seq"])
        want = g if len(g) <= 15 else g.iloc[np.linspace(0, len(g) - 1, 15).astype(int)]
        assert set(got[got.k == k].seq) == set(want.seq)


def test_precision_recall_groups_ties(spark):
    df = spark.createDataFrame([(0.9, True), (0.9, False), (0.5, True), (0.2, False)], "score double, positive boolean")
    r = average_precision(precision_recall(df)).head()
    assert r.average_precision == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert r.pr_auc_trapezoid == pytest.approx(0.5 * 0.75 + 0.5 * (2 / 3 + 0.5) / 2, abs=1e-8)
    t = {x.threshold: (x.tp, x.fp, x.fn, x.tn) for x in threshold_table(df, [0.5, 0.95]).collect()}
    assert t == {0.5: (2, 1, 0, 1), 0.95: (0, 0, 2, 2)}


def test_record_set_digest_sums_beyond_64_bits_and_counts_beside(spark):
    import hashlib

    from phasemill.functions.hashing import record_set_digest

    n = 70_000  # lanes of 48 bits: their sums pass 2^63
    df = spark.range(n).select((F.col("id") % 2).alias("g"), F.lit(1).alias("v"))
    h = hashlib.sha256(b'{"v":1}').hexdigest()
    want = hashlib.sha256(":".join([str(n // 2), *[str(n // 2 * int(h[12 * i: 12 * i + 12], 16)) for i in range(5)]]).encode()).hexdigest()
    got = record_set_digest(df, ["g"], ["v"], [F.count_if(F.col("v") == 1).alias("ones")]).collect()
    assert [(r.n_rows, r.ones, r.digest) for r in got] == [(n // 2, n // 2, want)] * 2
