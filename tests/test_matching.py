"""Matching against brute force, with gaps, wide windows and one series that holds most rows."""

import math
import random

from phasemill.operators import matching as mt

MULTIPLIERS = [0.5, 1.0, 2.0]


def _data(seed):
    rng = random.Random(seed)
    runs = [(s, float(b), b + rng.choice([0.3, 2.5, 4.0])) for s in range(4) for b in range(0, 30, 6)]
    cand = [(s, 10 * s + i, rng.uniform(1.0, 6.0), rng.uniform(0.0, 5.0), rng.uniform(0.1, 0.9)) for s in range(4) for i in range(6 if s else 40)]
    sel = []
    for i in range(160):
        s, cid, p, e, d = rng.choice(cand)
        sel.append((i, s, p * rng.choice([1.0, 1.0, 0.5, 2.0]) + rng.uniform(-0.01, 0.01), d * rng.uniform(0.7, 1.7) / p, e + rng.uniform(-0.05, 0.05)))
    sel.append((160, 9, 3.0, 0.1, 1.0))
    cand += [(5, 500, 3.0, 1.0, 0.5)]  # a series without data
    return runs, cand, sel + [(161, 5, 3.0, 0.1, 1.0)]


def _frames(spark, runs, cand, sel):
    return (spark.createDataFrame(runs, "series_id int, r0 double, r1 double"), spark.createDataFrame(cand, "series_id int, cid int, period double, epoch double, duration double"),
            spark.createDataFrame(sel, "id int, series_id int, period double, width double, epoch double"))


def _expected(runs, cand, sel):
    out = {}
    for i, s, p, w, e in sel:
        for s2, cid, cp, ce, cd in cand:
            if s2 != s:
                continue
            mine = [r for r in runs if r[0] == s]
            centres = [ce + k * cp for k in range(math.floor((0.0 - ce) / cp) - 1, math.ceil((30.0 - ce) / cp) + 2)]
            centres = [c for c in centres if any(max(c - cd / 2, a) <= min(c + cd / 2, b) for _, a, b in mine)]
            overlap = 0
            for c in centres:
                m = e + math.floor((c - e) / p + 0.5) * p
                lo, hi = max(c - cd / 2, m - w * p / 2), min(c + cd / 2, m + w * p / 2)
                overlap += lo <= hi and any(max(lo, a) <= min(hi, b) for _, a, b in mine)
            out[i, cid] = (len(centres), overlap)
    return out


def _evaluate(spark, runs, cand, sel):
    r, c, s = _frames(spark, runs, cand, sel)
    return s, mt.evaluate(s, c, mt.observed_events(c, r, 0.0, 30.0), MULTIPLIERS, min_window=0.1, ratio_min=0.8, ratio_max=1.6, min_overlap=1, transits_cap=6)


def test_counts_equal_brute_force(spark):
    runs, cand, sel = _data(3)
    _, ev = _evaluate(spark, runs, cand, sel)
    rows = ev.collect()
    assert {(r.id, r.candidate_id): (r.observed, r.overlap) for r in rows} == _expected(runs, cand, sel)
    assert len(rows) == 3 * len(_expected(runs, cand, sel))


def test_decision_equals_brute_force(spark):
    runs, cand, sel = _data(5)
    s, ev = _evaluate(spark, runs, cand, sel)
    got = {r.id: (r.status, r.candidate_id, r.multiplier) for r in mt.decide(s, ev, min_gap=0.05, dominance=0.9, overlap_tolerance=0.2).collect()}
    per = {}
    for r in ev.filter("pass").collect():
        per.setdefault(r.id, []).append(r)
    for i, *_ in sel:
        best = {}
        for r in sorted(per.get(i, []), key=lambda r: (r.score, r.multiplier)):
            best.setdefault((r.candidate_id, r.multiplier == 1), r)
        direct = [r for (_, d), r in best.items() if d]
        pool = sorted(direct or best.values(), key=lambda r: (r.score, r.candidate_id))
        if not pool:
            want = ("not_matched", None, None)
        else:
            one, two = pool[0], pool[1] if len(pool) > 1 else None
            bad = two is not None and (two.score - one.score < 0.05 or one.score > 0.9 * two.score or one.overlap_ratio < two.overlap_ratio - 0.2)
            want = ("ambiguous_match", None, None) if bad else ("matched" if one.multiplier == 1 else "matched_harmonic", one.candidate_id, one.multiplier)
        assert got[i] == want, i
    assert len({v[0] for v in got.values()}) >= 3


def test_event_points_equal_brute_force(spark):
    rng = random.Random(8)
    obs = [(s, rng.uniform(0, 30)) for s in range(3) for _ in range(300)]
    models = [(s, m, rng.uniform(0.5, 4), rng.uniform(-3, 3), rng.choice([0.2, 0.7, 5.0])) for s in range(4) for m in range(6)]
    got = mt.event_points(spark.createDataFrame(obs, "series_id int, t double"), spark.createDataFrame(models, "series_id int, m int, period double, epoch double, duration double"))
    want = []
    for s, t in obs:
        for s2, m, p, e, d in models:
            x = t - e + p / 2
            if s == s2 and abs(x - math.floor(x / p) * p - p / 2) < d / 2:
                want.append((s, m, t, math.floor((t - e) / p + 0.5)))
    assert sorted((r.series_id, r.m, r.t, r.k) for r in got.collect()) == sorted(want)


def test_empty_tables(spark):
    runs, cand, sel = _data(1)
    s, ev = _evaluate(spark, runs, cand, sel[:0] or [(0, 99, 1.0, 0.1, 0.0)])
    assert ev.count() == 0
    assert [r.status for r in mt.decide(s, ev, min_gap=0.05, dominance=0.9, overlap_tolerance=0.2).collect()] == ["not_matched"]


def test_plan_holds_no_lists(spark, capsys):
    runs, cand, sel = _data(1)
    s, ev = _evaluate(spark, runs, cand, sel)
    mt.decide(s, ev, min_gap=0.05, dominance=0.9, overlap_tolerance=0.2).explain("simple")
    plan = capsys.readouterr().out
    assert "collect_list" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
