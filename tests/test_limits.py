"""Limits show in the result: nothing is cut silently."""

import math

from pyspark.sql import functions as F

from phasemill.operators import binning
from phasemill.operators.discover import critical, paired_blocks


def test_over_long_part_is_a_status_row(spark):
    rows = [(1, 0, i, float(i), 1.0) for i in range(5)] + [(2, 0, 0, 0.0, 1.0), (2, 0, 1, 40.0, 2.0)]
    obs = spark.createDataFrame(rows, "series_id long, part_id int, seq long, t double, v double")
    g = binning.fixed_grid(obs, minutes=1440.0, valid=F.lit(True), max_bins=10)
    assert [(r.bin, r.n) for r in g.filter("status = 'point_limit'").collect()] == [(None, 0)]
    got = {r.series_id: (r.status, r.n_bins, r.n_kept) for r in binning.grid_summary(g).collect()}
    assert got == {1: ("ok", 5, 5), 2: ("point_limit", 0, 0)}
    assert {r.series_id for r in binning.runs(g, empty=True).collect()} <= {1}
    wide = binning.adaptive_grid(obs, minutes=1440.0, max_bins=10)
    assert {r.status for r in wide.select("status").distinct().collect()} == {"ok"}


def test_quantile_for_any_number_of_blocks():
    # Tables of the t distribution: 1 degree is tan, 2 degrees has a closed form, 3 degrees at 0.99975.
    assert math.isclose(critical(2), math.tan(math.pi * (0.5 - 0.0005)), rel_tol=1e-9)
    a = 1 - 0.002 / 3
    assert math.isclose(critical(3), a * math.sqrt(2 / (1 - a * a)), rel_tol=1e-9)
    assert abs(critical(4) - 16.3263) < 1e-4
    assert critical(25) < critical(14) < critical(4)
    assert math.isnan(critical(1))


def test_missing_block_holds_the_series(spark):
    def series(sid, skip):
        for i in range(int(104 / 0.05)):
            t = i * 0.05
            if skip and 40.0 <= t < 46.0:
                continue
            dip = abs(t - round(t / 2) * 2) < 0.5
            yield sid, i, t, (0.5 if dip else 1.0) + 0.001 * ((i * 7919) % 13 - 6)
    x = spark.createDataFrame([*series(1, False), *series(2, True)], "series_id long, seq long, t double, y double")
    out = paired_blocks(x, short=(2.0, 0.0, 1.0), long=(4.0, 0.0, 1.0), value="y", margin=0.1)
    got = {r.series_id: r for r in out.collect()}
    assert got[1].expected_blocks == got[1].paired_blocks == 25
    assert got[1].verdict == "equivalent_within_margin"
    assert got[2].verdict == "missing_distinguishing_windows" and got[2].paired_blocks < got[2].expected_blocks
