"""Period search, removal and iteration on injected signals."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasemill.operators import boxsearch as bs, identity, models as mo, peaks as pk
from phasemill.operators.iterate import iterate


def brute(t, n, s, n_total, s_total, sigma, periods, durations, oversample):
    out = []
    for p in periods:
        nb = max(int(np.ceil(p / (min(durations) / oversample))), 1)
        b = np.minimum(((t / p - np.floor(t / p)) * nb).astype(int), nb - 1)
        best = (0.0, None, None)
        for d in sorted(durations):
            k = max(int(np.floor(d * nb / p + 0.5)), 1)
            for i in range(nb if k < nb else 0):
                inside = (b - i) % nb < k
                ni, si = n[inside].sum(), s[inside].sum()
                if ni == 0 or ni == n_total:
                    continue
                depth = ((s_total - si) / (n_total - ni) - si / ni) / bs.SCALE
                power = 0.5 * ni * depth * depth / sigma ** 2
                if depth > 0 and power > best[0]:
                    best = (power, d, i)
        out.append(best)
    return out


def test_search_kernel_equals_brute_force():
    rng = np.random.default_rng(4)
    t = np.sort(rng.random(60) * 12)
    n = rng.integers(1, 4, 60).astype(float)
    s = np.round(n * (1 + 0.05 * rng.normal(size=60)) * bs.SCALE)
    periods, durations = np.linspace(0.7, 4, 23), [0.15, 0.3, 0.9]
    got = bs._search_one(t, n, s, int(n.sum()), int(s.sum()), 0.05, periods, durations, 3)
    want = brute(t, n, s, int(n.sum()), int(s.sum()), 0.05, periods, durations, 3)
    for g, w in zip(got, want):
        assert g[1] == pytest.approx(w[0], rel=1e-12) and g[5] == w[1]


def star(sid, signals, n=2400, noise=0.001, seed=0):
    rng = np.random.default_rng(seed + sid)
    t = np.sort(rng.random(n) * 27)
    v = 1 + noise * rng.normal(size=n)
    for p, e, d, h in signals:
        v[np.abs((t - e + p / 2) % p - p / 2) < d / 2] *= 1 - h
    return pd.DataFrame({"series_id": sid, "part_id": 0, "seq": np.arange(n), "t": t, "v": v})


@pytest.fixture(scope="module")
def curves(spark):
    two = [(3.3, 1.0, 0.2, 0.02), (5.7, 2.1, 0.25, 0.008)]
    return spark.createDataFrame(pd.concat([star(1, two), star(2, []), star(3, two[:1], n=60)]))


def test_iteration_accepts_injected_signals(curves):
    out = iterate(curves, periods=(1.0, 9.0, 3200), durations=[0.1, 0.2, 0.3], oversample=5, cell_days=0.01, rounds=3).toPandas()
    one = out[(out.series_id == 1) & (out.status == "accepted")].sort_values("step")
    assert list(np.round(one.period, 1)) == [3.3, 5.7]
    assert one.reason.eq("validated_on_original").all()
    assert one.depth.iloc[0] == pytest.approx(0.02, rel=0.15)
    ends = out[out.status == "terminated"].set_index("series_id").reason
    assert ends[1] in ("no_quality_peak", "duplicate_or_harmonic_only")
    assert ends[2] == "no_quality_peak" and ends[3] == "insufficient_observations"
    assert len(ends) == 3


def test_chunk_size_does_not_change_the_periodogram(curves):
    kw = dict(value="v", periods=(1.0, 9.0, 60), durations=[0.2], oversample=4, cell_days=0.02)
    key = lambda df: sorted((r.series_id, r.idx, r.power) for r in df.collect())
    assert key(bs.periodogram(curves, chunk=7, **kw)) == key(bs.periodogram(curves, chunk=60, **kw))


def test_a_series_is_split_by_work_and_searched_in_blocks(curves):
    kw = dict(value="v", periods=(1.0, 9.0, 60), durations=[0.2], oversample=4, cell_days=0.02)
    rows = lambda df: {(r.series_id, r.idx): (r.period, r.power, r.epoch, r.n_in) for r in df.collect()}
    whole = rows(bs.periodogram(curves, **kw))
    # Series 3 has few cells and stays whole; the others are split, in parts of different length.
    assert rows(bs.periodogram(curves, work=9000, **kw)) == whole
    assert len(whole) == 180 and {i for s, i in whole if s == 1} == set(range(60))
    periods = np.linspace(1.0, 9.0, 5000)
    blocks = bs._blocks(100_000, periods, 0.01)
    assert np.array_equal(np.concatenate(blocks), periods) and max(map(len, blocks)) * 100_000 <= bs.BLOCK + 100_000
    assert len(bs._blocks(2 * bs.BLOCK, periods[:5], 0.01)) == 5


def test_greedy_peaks_respect_the_separation(spark):
    rows = [(1, i, 1.0 + 0.01 * i, float(p)) for i, p in enumerate([1, 5, 9, 8, 2, 7, 3])]
    g = spark.createDataFrame(rows, "series_id int, idx bigint, period double, power double")
    got = [r.idx for r in pk.greedy_peaks(g, ["series_id"], 3, pk.relative_clash(0.015)).orderBy("rank").collect()]
    assert got == [2, 5, 0]


def test_removal_and_joint_depths(curves):
    one = curves.filter("series_id = 1")
    models = one.sparkSession.createDataFrame([(1, 1, 3.3, 1.0, 0.2, 0.02), (1, 2, 5.7, 2.1, 0.25, 0.008)], "series_id int, model_id int, period double, epoch double, duration double, depth double")
    res = mo.remove_models(one, models).toPandas()
    assert res.removal_status.eq("ok").all() and res.residual.std() == pytest.approx(0.001, rel=0.05)
    from phasemill.functions.phase import in_window
    fit = mo.joint_depths(one, ["series_id"], in_window("t", 3.3, 1.0, 0.2), in_window("t", 5.7, 2.1, 0.25), value="v").toPandas().iloc[0]
    d = one.toPandas()
    w = lambda p, e, q: (np.abs((d.t - e + p / 2) % p - p / 2) < q / 2).astype(float)
    X = np.column_stack([np.ones(len(d)), -w(3.3, 1.0, 0.2), -w(5.7, 2.1, 0.25)])
    beta, rss, *_ = np.linalg.lstsq(X, d.v, rcond=None)
    err = np.sqrt(rss[0] / (len(d) - 3) * np.diag(np.linalg.inv(X.T @ X)))
    assert [fit.depth_a, fit.depth_b] == pytest.approx(beta[1:].tolist(), rel=1e-8)
    assert [fit.err_a, fit.err_b] == pytest.approx(err[1:].tolist(), rel=1e-6)


def test_running_median_equals_numpy(spark):
    rng = np.random.default_rng(0)
    y = rng.random(50)
    pg = spark.createDataFrame([(1, i, float(i), float(v)) for i, v in enumerate(y)], "series_id int, idx bigint, period double, power double")
    got = [r.sde for r in bs.running_median_sde(pg, size=7).orderBy("idx").collect()]
    pad = np.concatenate([y[:3][::-1], y, y[-3:][::-1]])
    r = y - np.array([np.median(pad[i:i + 7]) for i in range(50)])
    assert got == pytest.approx(((r - r.mean()) / r.std()).tolist())


def test_reconcile_holds_ambiguity(spark):
    cols = "series_id int, cid bigint, period double, epoch double, duration double, depth double, score double"
    row = lambda s, c, p, e=1.0: (s, c, p, e, 0.2, 0.01, 1.0)
    old = spark.createDataFrame([row(1, 1, 3.0), row(2, 1, 3.0), row(3, 1, 3.0)], cols)
    new = spark.createDataFrame([row(1, 11, 3.0001), row(1, 12, 7.1), row(2, 11, 3.0), row(2, 12, 3.0, 1.01), row(3, 11, 6.0)], cols)
    got = {r.series_id: (r.status, r.matched, r.added, r.retired) for r in identity.reconcile(old, new, 0.0, 27.0, 0.5).collect()}
    assert got == {1: ("resolved", 1, 1, 0), 2: ("ambiguous", 0, 0, 0), 3: ("possible_alias", 0, 0, 0)}


def test_biweight_of_a_batch_equals_one_window_at_a_time():
    from phasemill.operators.cleaning import biweight
    rng = np.random.default_rng(8)
    windows = [np.sort(rng.normal(1, 0.1, n)) for n in (1, 2, 5, 30, 31)] + [np.ones(6), np.sort(np.r_[np.ones(5), 9.0])]
    want = []
    for x in windows:
        m = np.median(x)
        for _ in range(3):
            mad = np.median(np.abs(x - m))
            if mad == 0:
                break
            u = (x - m) / (6 * mad)
            w = np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0)
            m = (w * x).sum() / w.sum()
        want.append(m)
    filled = np.full((len(windows), 31), np.nan)
    for row, w in zip(filled, windows):
        row[:len(w)] = w
    assert biweight(filled, np.array([len(w) for w in windows])).tolist() == pytest.approx(want, rel=1e-12)


def test_block_stencil_equals_each_window_and_sends_a_point_to_two_blocks_at_most(spark):
    from phasemill.operators import cleaning
    rng = np.random.default_rng(12)
    # Points and windows on block edges, a sparse run, a missing value and a run of one point.
    t = np.unique(np.r_[np.arange(0, 12, 0.25), np.round(rng.random(200) * 12, 3), 40.0, 41.9, 90.0])
    v = 1 + 0.1 * rng.normal(size=len(t))
    v[7] = np.nan
    rows = [(1, 0, i + 1, len(t), float(a), None if np.isnan(b) else float(b)) for i, (a, b) in enumerate(zip(t, v))] + [(2, 0, 1, 1, 3.0, 5.0)]
    x = spark.createDataFrame(rows, "series_id int, segment_id bigint, _n bigint, _size bigint, t double, v double")
    got = {(r.series_id, r.t): r.centre for r in cleaning.anchor_centres(x, ["series_id", "segment_id"], stride=7, half_window=0.5, value="v").collect()}
    at = t[(np.arange(len(t)) % 7 == 0) | (np.arange(len(t)) == len(t) - 1)]
    want = {(2, 3.0): 5.0}
    for a in at:
        w = v[(t >= a - 0.5) & (t <= a + 0.5)]
        w = np.sort(w[~np.isnan(w)])
        if len(w):
            want[1, a] = cleaning.biweight(w[None, :], np.array([len(w)]))[0]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    plan = cleaning.anchor_centres(x, ["series_id", "segment_id"], stride=7, half_window=0.5, value="v")._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_removal_failures_are_named_in_order_and_fail_closed(spark):
    from pyspark.sql import functions as F

    from phasemill.operators.iterate import removal_failures

    fields = ("name string, n_valid_input long, n_finite_residual long, power_ratio double, edge_excess double, n_others int, n_others_measured int, "
              "other_depth_log2_max double, overlap_dev double, window_offset_z double, window_offset_rel double")
    good = [100, 100, 0.2, 0.7, 1, 1, 0.1, 0.5, 0.3, 0.01]
    change = lambda name, at, v: [name, *good[:at], v, *good[at + 1:]]
    rows = [["", *good], change("non_finite", 1, 99), change("power_not_reduced", 2, 0.51), change("power_not_reduced", 2, None), change("edge_excess", 3, 1.6),
            change("other_depth_not_measurable", 5, 0), change("other_candidate_damaged", 6, 1.1), change("overlap_distortion", 7, 3.1), change("qa_not_measurable", 3, None),
            change("qa_not_measurable", 8, None), ["window_offset", *good[:8], -5.1, 0.2], ["window_offset", *good[:8], 6.0, None], ["", *good[:8], 6.0, -0.1],
            ["non_finite,power_not_reduced,edge_excess,other_depth_not_measurable,other_candidate_damaged,overlap_distortion,window_offset", 100, 99, 0.9, 2.0, 2, 1, 1.5, 4.0, 9.0, 0.5]]
    got = spark.createDataFrame([tuple(r) for r in rows], fields).select("name", F.concat_ws(",", removal_failures()).alias("got")).collect()
    assert [r.got for r in got] == [r[0] for r in rows]


def test_iteration_notes_rejected_steps(curves):
    """A gate no peak passes: the step is kept with its measurements and the series ends."""
    out = iterate(curves.filter("series_id = 1"), periods=(1.0, 9.0, 400), durations=[0.2], oversample=4, cell_days=0.02, snr_min=1e6).toPandas()
    step = out[out.status == "rejected_gate"].iloc[0]
    assert step.reason == "no_quality_peak" and step.snr > 0 and step.period_coarse > 0 and step.n_transits > 1
    assert out[out.status == "terminated"].reason.tolist() == ["no_quality_peak"] and len(out) == 2


def test_strict_maxima_leave_plateaus_and_edges(spark):
    rows = [(1, i, float(p)) for i, p in enumerate([9, 1, 5, 5, 2, 7, 3, 8])]
    g = spark.createDataFrame(rows, "series_id int, idx bigint, power double")
    assert [r.idx for r in pk.local_maxima(g, ["series_id"], "idx", "power", strict=True).collect()] == [5]
    assert sorted(r.idx for r in pk.local_maxima(g, ["series_id"], "idx", "power").collect()) == [0, 2, 5, 7]


def test_one_unmeasured_candidate_holds_its_series(spark, curves):
    models = spark.createDataFrame([(s, m, p, e, d, h) for s in (1, 2, 3, 4) for m, p, e, d, h in ((1, 3.3, 1.0, 0.2, 0.02), (2, 5.7, 2.1, 0.25, 0.008))],
                                   "series_id int, model_id int, period double, epoch double, duration double, depth double")
    grid = (1.0, 9.0, 3200)
    search = lambda pts: bs.periodogram(pts, value="v", periods=grid, durations=[0.1, 0.2, 0.3], oversample=5, cell_days=0.01, spacing="log")
    from phasemill.operators.discover import prefix_run
    run = prefix_run(curves, models, search, value="v", steps=2, grid=grid, cadence_days=0.02, half_cells=12, min_points=100).toPandas().set_index(["series_id", "model_id"])
    assert run.loc[1].decision.tolist() == ["discoverable", "discoverable"]
    assert run.loc[2].decision.tolist() == ["not_discoverable", "not_discoverable"]
    for s in (3, 4):  # too few points, and none
        assert run.loc[s].decision.tolist() == ["held", "held"] and run.loc[s].discoverable.isna().all() and run.loc[s].reason.eq("insufficient_observations").all()


def test_best_boxes_wrap_and_never_cover_a_period():
    from phasemill.operators import boxsearch as bs

    t, n, s = np.arange(0.05, 4, 0.1), np.ones(40), np.full(40, bs.SCALE, float)
    s[np.isin(np.arange(40) % 20, (0, 19))] = 0.5 * bs.SCALE  # a dip over the end of a period of 2 days
    periods, best, depth, _, _, duration, epoch, n_in = bs._best_boxes(t, n, s, 40, int(s.sum()), 0.1, [2.0, 0.15], [0.2, 2.0], 2)
    assert depth[0] == 0.5 and duration[0] == 0.2 and n_in[0] == 4 and epoch[0] % 2 < 1e-9
    assert best[1] == 0 and np.isnan(depth[1])  # every box is as long as the period
