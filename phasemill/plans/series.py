"""Series: cleaning, binning, folding."""

from pyspark.sql import functions as F

from phasemill.functions.phase import box_factor, cycle, in_window, phase_distance, phase_fold
from phasemill.operators import binning, cleaning
from phasemill.operators.medians import grouped_mad, grouped_median
from phasemill.operators.ordered import bracketing, numbered, segmented, with_neighbours
from phasemill.plans.registry import query



def week():
    return F.floor(F.col("t") / 7.5)


GOOD = "good AS (SELECT * FROM obs WHERE q=0)"


def r8(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 8).alias(name) if name else F.round(c, 8)


@query("fil01_quality_filter", "SELECT series_id, count(*) AS n, round(sum(v),4) AS total FROM obs WHERE q=0 AND isfinite(t) AND isfinite(v) GROUP BY series_id", "obs")
def _(t):
    return cleaning.quality_filter(t.obs()).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("ts01_part_median_normalise",
       """SELECT series_id, part_id, seq, round(v/med,8) AS nv, CASE WHEN med>0 THEN 'ok' ELSE 'invalid_normalization' END AS norm_status
       FROM good JOIN (SELECT series_id, part_id, median(v) AS med FROM good GROUP BY ALL) USING (series_id, part_id)""", "obs", GOOD)
def _(t):
    return cleaning.normalise_parts(cleaning.quality_filter(t.obs())).select("series_id", "part_id", "seq", r8("nv", "nv"), "norm_status")


@query("ts09_folded_median_snapshot",
       """, f AS (SELECT series_id, v, least(floor((t-floor(t))*24),23) AS b FROM good),
       m AS (SELECT series_id, b, median(v) AS med, count(*) AS n FROM f GROUP BY ALL)
       SELECT f.series_id, CAST(f.b AS BIGINT) AS bin, round(m.med,8) AS med, round(1.4826*median(abs(v-med)),8) AS scatter, m.n FROM f JOIN m USING (series_id, b)
       GROUP BY f.series_id, f.b, m.med, m.n""", "obs", GOOD)
def _(t):
    x = cleaning.quality_filter(t.obs())
    return binning.folded_medians(x, period=F.lit(1.0), reference=F.lit(0.0), bins=24).select(
        "series_id", "bin", r8("med", "med"), r8("scatter", "scatter"), "n")


@query("wn05_gap_segments",
       """, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 1.0 THEN 1 ELSE 0 END AS o FROM good WINDOW w AS (PARTITION BY series_id, part_id ORDER BY t, seq)),
       s AS (SELECT *, sum(o) OVER (PARTITION BY series_id, part_id ORDER BY t, seq) AS segment_id FROM g)
       SELECT series_id, part_id, CAST(segment_id AS BIGINT) AS segment_id, count(*) AS n, round(min(t),8) AS t0, round(max(t),8) AS t1 FROM s GROUP BY series_id, part_id, segment_id""", "obs", GOOD)
def _(t):
    x = segmented(cleaning.quality_filter(t.obs()), ["series_id", "part_id"], ["t", "seq"], "t", 1.0, F.floor("t"))
    return x.groupBy("series_id", "part_id", "segment_id").agg(F.count(F.lit(1)).alias("n"), r8(F.min("t"), "t0"), r8(F.max("t"), "t1"))


BINNED = """
st AS (SELECT series_id, part_id, min(t) AS s, max(t) AS e FROM obs GROUP BY ALL),
sc AS (SELECT o.*, s, (t-s)*1440/720.0 AS x, (e-s)*1440/720.0 AS xe FROM obs o JOIN st USING (series_id, part_id)),
bn AS (SELECT *, CAST(floor(CASE WHEN abs(x-round_even(x,0))<=1e-8 THEN round_even(x,0) ELSE x END) AS BIGINT) AS bin,
       CAST(floor(CASE WHEN abs(xe-round_even(xe,0))<=1e-8 THEN round_even(xe,0) ELSE xe END) AS BIGINT)+1 AS nb FROM sc),
cells AS (SELECT series_id, part_id, bin, avg(v) AS flux, count(*) AS n FROM bn WHERE q=0 GROUP BY ALL),
grid AS (SELECT sp.series_id, sp.part_id, sp.bin, sp.s, status, flux, coalesce(n,0) AS n, sp.s + (sp.bin+0.5)*720.0/1440 AS centre
  FROM (SELECT series_id, part_id, s, CASE WHEN nb<=20000 THEN 'ok' ELSE 'point_limit' END AS status, unnest(CASE WHEN nb<=20000 THEN range(nb) ELSE [NULL::BIGINT] END) AS bin FROM (SELECT DISTINCT series_id, part_id, s, nb FROM bn)) sp
  LEFT JOIN cells USING (series_id, part_id, bin))"""


def half_day_grid(t):
    return binning.fixed_grid(t.obs(), minutes=720.0, valid=F.col("q") == 0)


@query("ts04_fixed_grid_bins", "SELECT series_id, part_id, status, bin, round(flux,8) AS flux, n FROM grid", "obs", BINNED)
def _(t):
    return half_day_grid(t).select("series_id", "part_id", "status", "bin", r8("flux", "flux"), "n")


@query("ts04_grid_summary",
       """, m AS (SELECT series_id, part_id, median(flux) AS med FROM grid WHERE flux IS NOT NULL GROUP BY ALL),
       d AS (SELECT series_id, part_id, 1.4826*median(abs(flux-med)) AS scatter FROM grid JOIN m USING (series_id, part_id) WHERE flux IS NOT NULL GROUP BY ALL)
       SELECT series_id, part_id, status, count(bin) AS n_bins, count(flux) AS n_filled, CAST(sum(n) AS BIGINT) AS n_kept, round(any_value(scatter),8) AS scatter
       FROM grid LEFT JOIN d USING (series_id, part_id) GROUP BY ALL""", "obs", BINNED)
def _(t):
    return binning.grid_summary(half_day_grid(t)).select("series_id", "part_id", "status", "n_bins", "n_filled", "n_kept", r8("scatter", "scatter"))


@query("ts05_adaptive_grid_bins",
       """, w AS (SELECT series_id, part_id, min(t) AS s, 60.0*greatest(1, floor((max(t)-min(t))*1440/(60.0*12))+1) AS mins FROM good GROUP BY ALL),
       b AS (SELECT series_id, part_id, v, s, mins, (t-s)*1440/mins AS x FROM good JOIN w USING (series_id, part_id)),
       c AS (SELECT series_id, part_id, mins, CAST(floor(CASE WHEN abs(x-round_even(x,0))<=1e-8 THEN round_even(x,0) ELSE x END) AS BIGINT) AS bin, v FROM b)
       SELECT series_id, part_id, bin, round(mins,8) AS bin_minutes, round(median(v),8) AS flux, count(*) AS n FROM c GROUP BY series_id, part_id, mins, bin""", "obs", GOOD)
def _(t):
    g = binning.adaptive_grid(cleaning.quality_filter(t.obs()), minutes=60.0, max_bins=12, reducer="median")
    return g.filter("n > 0").select("series_id", "part_id", "bin", r8("bin_minutes", "bin_minutes"), r8("flux", "flux"), "n")


@query("ts06_grid_times", "SELECT series_id, part_id, status, count(bin) AS n, round(min(s + bin*720.0/1440),8) AS first_start, round(max(centre),8) AS last_centre FROM grid GROUP BY ALL", "obs", BINNED)
def _(t):
    g = half_day_grid(t)
    start = F.col("start") + F.col("bin") * F.col("bin_minutes") / 1440
    return g.groupBy("series_id", "part_id", "status").agg(F.count("bin").alias("n"), r8(F.min(start), "first_start"), r8(F.max("centre"), "last_centre"))


RUNS = """, r AS (SELECT *, bin - row_number() OVER (PARTITION BY series_id, part_id ORDER BY bin) AS g FROM grid WHERE flux IS {0}NULL)
SELECT series_id, part_id, min(bin) AS first_bin, max(bin) AS last_bin{1} FROM r GROUP BY series_id, part_id, g"""


@query("wn06_null_runs", RUNS.format("", ""), "obs", BINNED)
def _(t):
    return binning.runs(half_day_grid(t), empty=True).select("series_id", "part_id", "first_bin", "last_bin")


@query("wn07_observed_runs", RUNS.format("NOT ", ", round(min(centre),8) AS t0, round(max(centre),8) AS t1"), "obs", BINNED)
def _(t):
    return binning.runs(half_day_grid(t), empty=False).select("series_id", "part_id", "first_bin", "last_bin", r8("t_first", "t0"), r8("t_last", "t1"))


@query("wn08_strict_local_maxima",
       """, l AS (SELECT *, lag(flux) OVER w AS p, lead(flux) OVER w AS x FROM grid WINDOW w AS (PARTITION BY series_id, part_id ORDER BY bin))
       SELECT series_id, part_id, bin, round(flux,8) AS flux FROM l WHERE flux IS NOT NULL AND (p IS NULL OR flux>p) AND (x IS NULL OR flux>=x)
         AND (coalesce(flux>p,false) OR coalesce(flux>x,false))""", "obs", BINNED)
def _(t):
    from phasemill.operators.peaks import local_maxima
    return local_maxima(half_day_grid(t), ["series_id", "part_id"], "bin", "flux").select("series_id", "part_id", "bin", r8("flux", "flux"))


BIWEIGHT = """
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY series_id, part_id ORDER BY t, seq) > 3.0 THEN 1 ELSE 0 END AS o FROM obs WHERE q=0),
s AS (SELECT *, sum(o) OVER (PARTITION BY series_id, part_id ORDER BY t, seq) AS sg FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY series_id, part_id, sg ORDER BY t, seq) AS k, count(*) OVER (PARTITION BY series_id, part_id, sg) AS c FROM s),
a AS (SELECT series_id, part_id, sg, t AS tat FROM n WHERE (k-1)%5=0 OR k=c),
w AS (SELECT a.*, n.v FROM a JOIN n ON a.series_id=n.series_id AND a.part_id=n.part_id AND a.sg=n.sg AND n.t BETWEEN a.tat-2.0 AND a.tat+2.0),
w0 AS (SELECT w.*, m FROM w JOIN (SELECT series_id, part_id, sg, tat, median(v) AS m FROM w GROUP BY ALL) USING (series_id, part_id, sg, tat)),
{rounds}
ct AS (SELECT DISTINCT series_id, part_id, sg, tat, m FROM w3),
b AS (SELECT n.*, ct.m AS cm, CASE WHEN ct.m IS NOT NULL THEN n.t END AS ct_t FROM n LEFT JOIN ct ON n.series_id=ct.series_id AND n.part_id=ct.part_id AND n.sg=ct.sg AND n.t=ct.tat),
i AS (SELECT *, last_value(ct_t IGNORE NULLS) OVER lo AS lt, last_value(cm IGNORE NULLS) OVER lo AS lm,
   first_value(ct_t IGNORE NULLS) OVER hi AS ht, first_value(cm IGNORE NULLS) OVER hi AS hm FROM b
   WINDOW lo AS (PARTITION BY series_id, part_id, sg ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          hi AS (PARTITION BY series_id, part_id, sg ORDER BY t, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
tr AS (SELECT i.series_id, i.part_id, i.seq, i.t, i.v, i.sg AS segment_id, CASE WHEN c<3 THEN median(v) OVER (PARTITION BY i.series_id, i.part_id, sg)
   WHEN lt IS NULL THEN hm WHEN ht IS NULL OR ht=lt THEN lm ELSE lm+(hm-lm)*(t-lt)/(ht-lt) END AS trend FROM i)
""".format(rounds="\n".join(f"""d{i} AS (SELECT series_id, part_id, sg, tat, median(abs(v-m)) AS mad FROM w{i - 1} GROUP BY ALL),
u{i} AS (SELECT w{i - 1}.*, mad, CASE WHEN mad=0 THEN 0 WHEN abs((v-m)/(6.0*mad))<1 THEN pow(1-((v-m)/(6.0*mad))*((v-m)/(6.0*mad)),2) ELSE 0 END AS wt FROM w{i - 1} JOIN d{i} USING (series_id, part_id, sg, tat)),
w{i} AS (SELECT series_id, part_id, sg, tat, v, m2 AS m FROM u{i} JOIN (SELECT series_id, part_id, sg, tat, CASE WHEN any_value(mad)=0 OR sum(wt)=0 THEN any_value(m) ELSE sum(wt*v)/sum(wt) END AS m2 FROM u{i} GROUP BY ALL) USING (series_id, part_id, sg, tat)),"""
                            for i in (1, 2, 3)))


def trended(t):
    return cleaning.biweight_trend(cleaning.quality_filter(t.obs()), gap_days=3.0, stride=5, half_window=2.0)


@query("wn09_biweight_trend", "SELECT series_id, part_id, seq, CAST(segment_id AS BIGINT) AS segment_id, round(trend,5) AS trend FROM tr", "obs", BIWEIGHT)
def _(t):
    return trended(t).select("series_id", "part_id", "seq", "segment_id", F.round("trend", 5).alias("trend"))


@query("ts02_detrend_clip",
       """, f AS (SELECT *, CASE WHEN trend>0 THEN v/trend END AS fd FROM tr),
       m AS (SELECT series_id, median(fd) AS med FROM f GROUP BY ALL),
       sc AS (SELECT f.series_id, 1.4826*median(abs(fd-med)) AS scatter FROM f JOIN m USING (series_id) GROUP BY ALL),
       k AS (SELECT f.*, CASE WHEN fd IS NULL THEN 'invalid_trend' WHEN NOT fd<1+5.0*scatter THEN 'upper_clip' END AS reason FROM f JOIN sc USING (series_id)),
       c AS (SELECT series_id, count(*) FILTER (reason='invalid_trend') AS bad, count(*) FILTER (reason IS NULL) AS n_kept, count(*) AS n_total FROM k GROUP BY ALL)
       SELECT series_id, seq, round(fd,5) AS fd, reason, CASE WHEN n_total<20 THEN 'insufficient_observations' WHEN bad>0 THEN 'numerical_failure'
         WHEN n_kept>=20 THEN 'ok' ELSE 'insufficient_observations' END AS series_status FROM k JOIN c USING (series_id)""", "obs", BIWEIGHT)
def _(t):
    return cleaning.clip_upper(trended(t), value="v", min_points=20).select(
        "series_id", "seq", F.round("fd", 5).alias("fd"), "reason", "series_status")


@query("wn10_anchor_interpolation",
       """, i AS (SELECT *, last_value(CASE WHEN seq%7=0 THEN t END IGNORE NULLS) OVER lo AS lt, last_value(CASE WHEN seq%7=0 THEN v END IGNORE NULLS) OVER lo AS lv,
         first_value(CASE WHEN seq%7=0 THEN t END IGNORE NULLS) OVER hi AS ht, first_value(CASE WHEN seq%7=0 THEN v END IGNORE NULLS) OVER hi AS hv FROM obs
         WINDOW lo AS (PARTITION BY series_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                hi AS (PARTITION BY series_id ORDER BY t, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
       SELECT series_id, seq, round(CASE WHEN lt IS NULL THEN hv WHEN ht IS NULL OR ht=lt THEN lv ELSE lv+(hv-lv)*(t-lt)/(ht-lt) END,8) AS interp FROM i""", "obs", "dummy AS (SELECT 1)")
def _(t):
    x = t.obs().withColumns({"at": F.col("t"), "av": F.col("v")})
    b = bracketing(x, ["series_id"], ["t", "seq"], F.col("seq") % 7 == 0, ["at", "av"], week())
    return b.select("series_id", "seq", r8(cleaning.interpolated("lo_at", "lo_av", "hi_at", "hi_av", "t"), "interp"))


SAVGOL = """
n AS (SELECT *, row_number() OVER (PARTITION BY series_id, part_id ORDER BY t, seq) AS k FROM obs WHERE q=0),
fits AS (SELECT a.series_id, a.part_id, a.k AS kc, sum(b.v) AS s0, sum((b.k-a.k)*b.v) AS s1, sum((b.k-a.k)*(b.k-a.k)*b.v) AS s2 FROM n a JOIN n b
  ON a.series_id=b.series_id AND a.part_id=b.part_id AND b.k BETWEEN a.k-5 AND a.k+5 GROUP BY ALL HAVING count(*)=11),
co AS (SELECT series_id, part_id, kc, (1958.0*s0-110.0*s2)/(11*1958.0-110.0*110.0) AS a0, s1/110.0 AS a1, (11*s2-110.0*s0)/(11*1958.0-110.0*110.0) AS a2 FROM fits),
rg AS (SELECT series_id, part_id, min(kc) AS k0, max(kc) AS k1 FROM co GROUP BY ALL),
tr AS (SELECT n.series_id, n.part_id, n.seq, n.t, n.v, a0+a1*(k-kc)+a2*(k-kc)*(k-kc) AS trend FROM n LEFT JOIN rg USING (series_id, part_id)
  LEFT JOIN co ON co.series_id=n.series_id AND co.part_id=n.part_id AND kc=least(greatest(k,k0),k1))"""


@query("wn13_quadratic_trend", "SELECT series_id, part_id, seq, round(trend,5) AS trend FROM tr", "obs", SAVGOL)
def _(t):
    return cleaning.quadratic_trend(cleaning.quality_filter(t.obs()), half=5, block=32).select("series_id", "part_id", "seq", F.round("trend", 5).alias("trend"))


@query("ts03_smooth_clean",
       """, nm AS (SELECT tr.*, median(v) OVER (PARTITION BY series_id, part_id) AS pm FROM tr),
       f AS (SELECT *, CASE WHEN trend>0 THEN (v/pm)/(trend/pm) END AS fd FROM nm),
       m AS (SELECT series_id, median(fd) AS med FROM f WHERE fd IS NOT NULL GROUP BY ALL),
       sc AS (SELECT f.series_id, 1.4826*median(abs(fd-med)) AS scatter FROM f JOIN m USING (series_id) WHERE fd IS NOT NULL GROUP BY ALL)
       SELECT series_id, count(*) AS n_total, count(*) FILTER (fd<1+3.0*scatter) AS n_kept, round(any_value(scatter),5) AS scatter FROM f LEFT JOIN sc USING (series_id) GROUP BY series_id""", "obs", SAVGOL)
def _(t):
    x = cleaning.normalise_parts(cleaning.quality_filter(t.obs()))
    x = cleaning.clip_upper(cleaning.quadratic_trend(x, value="nv", half=5, block=32), value="nv", n_sigma=3.0)
    return x.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_total"), F.count_if("kept").alias("n_kept"), F.round(F.first("scatter"), 5).alias("scatter"))


@query("wn14_local_scatter",
       """, x AS (SELECT *, CAST(floor(t/5.0) AS BIGINT) AS win FROM good),
       m AS (SELECT series_id, win, median(v) AS m, count(*) AS n FROM x GROUP BY ALL),
       l AS (SELECT x.series_id, x.win, any_value(n) AS n, 1.4826*median(abs(v-m)) AS s FROM x JOIN m USING (series_id, win) GROUP BY x.series_id, x.win),
       g AS (SELECT series_id, 1.4826*median(abs(v-m)) AS gs FROM x JOIN (SELECT series_id, median(v) AS m FROM x GROUP BY ALL) USING (series_id) GROUP BY series_id)
       SELECT series_id, win, n, round(CASE WHEN n>=8 AND s>0 THEN s ELSE gs END,8) AS scatter FROM l JOIN g USING (series_id)""", "obs", GOOD)
def _(t):
    return cleaning.local_scatter(cleaning.quality_filter(t.obs()), window_days=5.0, min_points=8).select("series_id", "win", "n", r8("scatter", "scatter"))


@query("wn15_interior_mask",
       """, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY series_id ORDER BY t, seq) >= 1.0 THEN 1 ELSE 0 END AS o FROM good),
       s AS (SELECT *, sum(o) OVER (PARTITION BY series_id ORDER BY t, seq) AS sg FROM g),
       e AS (SELECT *, min(t) OVER (PARTITION BY series_id, sg) AS t0, max(t) OVER (PARTITION BY series_id, sg) AS t1 FROM s)
       SELECT series_id, seq, CAST(sg AS BIGINT) AS segment_id FROM e WHERE t-t0>=0.5 AND t1-t>=0.5""", "obs", GOOD)
def _(t):
    return cleaning.interior(cleaning.quality_filter(t.obs()), gap_days=1.0, edge_hours=12.0).select("series_id", "seq", "segment_id")


@query("wn16_duplicate_times",
       "SELECT l_suppkey AS series_id, l_shipdate AS shipped, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*)>1")
def _(t):
    return (t.lineitem.groupBy(F.col("l_suppkey").alias("series_id"), F.col("l_shipdate").alias("shipped"))
            .agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))


@query("ts07_signed_phase_distance",
       "SELECT series_id, seq, round((t-1.0+3.3/2)-floor((t-1.0+3.3/2)/3.3)*3.3-3.3/2,8) AS phase_days FROM obs", "obs")
def _(t):
    return t.obs().select("series_id", "seq", r8(phase_distance("t", 3.3, 1.0), "phase_days"))


@query("ts08_phase_fold", "SELECT series_id, seq, round((t-0.25)/2.7-floor((t-0.25)/2.7),8) AS phase FROM obs", "obs")
def _(t):
    return t.obs().select("series_id", "seq", r8(phase_fold("t", 0.25, 2.7), "phase"))


@query("ts10_folded_means_in_view",
       """, c AS (SELECT series_id, CAST(least(floor((t/2.0-floor(t/2.0))*20),19) AS BIGINT) AS b, avg(v) AS m, count(*) AS n FROM good GROUP BY ALL HAVING count(*)>=2)
       SELECT series_id, b+k*20 AS view_bin, round(m,8) AS mean_v, n FROM c, (VALUES (-1),(0)) z(k)""", "obs", GOOD)
def _(t):
    g = binning.folded_means(cleaning.quality_filter(t.obs()), period=F.lit(2.0), reference=F.lit(0.0), bins=20, min_count=2)
    return g.select("series_id", "view_bin", r8("mean_v", "mean_v"), "n")


@query("ts11_overlapping_bin_view",
       """, p AS (SELECT series_id, v, t/2.0-floor(t/2.0) AS p FROM good), b AS (SELECT unnest(range(16)) AS bin),
       m AS (SELECT series_id, bin, median(v) AS med FROM p, b WHERE bin>=ceil((p-0.2/2)*16-0.5) AND bin<=floor((p+0.2/2)*16-0.5) GROUP BY ALL),
       sp AS (SELECT series_id, bin, med FROM (SELECT DISTINCT series_id FROM p) CROSS JOIN b LEFT JOIN m USING (series_id, bin)),
       i AS (SELECT *, last_value(CASE WHEN med IS NOT NULL THEN bin END IGNORE NULLS) OVER lo AS lb, last_value(med IGNORE NULLS) OVER lo AS lm,
         first_value(CASE WHEN med IS NOT NULL THEN bin END IGNORE NULLS) OVER hi AS hb, first_value(med IGNORE NULLS) OVER hi AS hm FROM sp
         WINDOW lo AS (PARTITION BY series_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), hi AS (PARTITION BY series_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
       f AS (SELECT series_id, bin, CASE WHEN lb IS NULL THEN hm WHEN hb IS NULL OR hb=lb THEN lm ELSE lm+(hm-lm)*(bin-lb)/(hb-lb) END AS y FROM i),
       c AS (SELECT *, y - median(y) OVER (PARTITION BY series_id) AS z FROM f)
       SELECT series_id, bin, round(z/nullif(abs(min(z) OVER (PARTITION BY series_id)),0),8) AS y FROM c""", "obs", GOOD)
def _(t):
    from phasemill.operators.peaks import scaled_view
    x = cleaning.quality_filter(t.obs())
    med = binning.overlapping_medians(x, phase=phase_fold("t", 0.0, 2.0), bins=16, width=0.2)
    return scaled_view(x.select("series_id").distinct(), med, bins=16).select("series_id", "bin", r8("y", "y"))


@query("ag32_robust_scatter",
       """, m AS (SELECT series_id, median(v) AS med FROM good GROUP BY ALL)
       SELECT series_id, round(any_value(med),8) AS med, round(1.4826*median(abs(v-med)),8) AS scatter FROM good JOIN m USING (series_id) GROUP BY series_id""", "obs", GOOD)
def _(t):
    return grouped_mad(cleaning.quality_filter(t.obs()), "series_id", F.col("v")).select("series_id", r8("med", "med"), r8("scatter", "scatter"))


@query("hx14_reference_time", "SELECT series_id, round(median(t),8) AS ref_time, round(max(t)-min(t),8) AS span_days FROM (SELECT DISTINCT series_id, t FROM obs) GROUP BY series_id", "obs")
def _(t):
    x = t.obs().select("series_id", "t").distinct()
    span = x.groupBy("series_id").agg(r8(F.max("t") - F.min("t"), "span_days"))
    return grouped_median(x, "series_id", F.col("t"), "ref").join(span, "series_id").select("series_id", r8("ref", "ref_time"), "span_days")


@query("wn03_ordinal_numbering", "SELECT series_id, seq, row_number() OVER (PARTITION BY series_id ORDER BY t, seq) AS ordinal FROM obs", "obs")
def _(t):
    return numbered(t.obs(), "series_id", ["t", "seq"], week(), "ordinal").select("series_id", "seq", "ordinal")


@query("ag33_observed_cycles",
       """SELECT series_id, CAST(floor((t-1.0)/3.3+0.5) AS BIGINT) AS cyc, count(*) AS n FROM obs WHERE q=0 AND abs((t-1.0+3.3/2)-floor((t-1.0+3.3/2)/3.3)*3.3-3.3/2)<0.8/2 GROUP BY ALL""", "obs")
def _(t):
    x = cleaning.quality_filter(t.obs()).filter(in_window("t", 3.3, 1.0, 0.8))
    return x.groupBy("series_id", cycle("t", 3.3, 1.0).alias("cyc")).agg(F.count(F.lit(1)).alias("n"))


@query("tk08_stable_sort", "SELECT series_id, seq, round(t,8) AS t FROM obs ORDER BY t, part_id, seq", "obs")
def _(t):
    return t.obs().orderBy("t", "part_id", "seq").select("series_id", "seq", r8("t", "t"))


@query("ts37_concatenated_grid",
       """SELECT series_id, part_id, bin, row_number() OVER (PARTITION BY series_id ORDER BY centre, part_id, bin)-1 AS sorted_index FROM grid""", "obs", BINNED)
def _(t):
    g = half_day_grid(t)
    x = numbered(g, "series_id", ["centre", "part_id", "bin"], F.floor(F.col("centre") / 30), "k")
    return x.select("series_id", "part_id", "bin", (F.col("k") - 1).alias("sorted_index"))
