"""Period search, peaks, models and residual diagnostics."""

from pyspark.sql import functions as F

from phasemill.functions.phase import cycle, in_window, phase_distance
from phasemill.operators import boxsearch as bs, cleaning, iterate as it, models as mo, peaks as pk
from phasemill.operators.medians import grouped_mad
from phasemill.plans.registry import query
from phasemill.session import cut_lineage

DURATIONS = [0.4, 0.8, 1.2]
GRID = (1.5, 9.5, 80)
OVERSAMPLE = 4
CELL = 0.02


def dist(t, p, e):
    return f"(({t}-{e}+{p}/2)-floor(({t}-{e}+{p}/2)/{p})*{p}-{p}/2)"


PTS = """pts AS (SELECT o.series_id, o.part_id, o.seq, o.t, o.v/m.med AS y FROM obs o JOIN (SELECT series_id, part_id, median(v) AS med FROM obs WHERE q=0 GROUP BY ALL) m USING (series_id, part_id) WHERE q=0),
sig AS (SELECT p.series_id, 1.4826*median(abs(y-m)) AS sigma FROM pts p JOIN (SELECT series_id, median(y) AS m FROM pts GROUP BY ALL) USING (series_id) GROUP BY p.series_id)"""

PG = PTS + """,
cel AS (SELECT series_id, (floor(t/0.02::DOUBLE)+0.5)*0.02::DOUBLE AS tc, count(*) AS n, CAST(sum(CAST(round(y*1000000000) AS BIGINT)) AS BIGINT) AS s FROM pts GROUP BY ALL),
tot AS (SELECT series_id, CAST(sum(n) AS BIGINT) AS nn, CAST(sum(s) AS BIGINT) AS ss FROM cel GROUP BY 1),
per AS (SELECT i AS idx, 1.5::DOUBLE+(9.5::DOUBLE-1.5::DOUBLE)*i/79 AS p FROM range(80) r(i)),
pb AS (SELECT idx, p, greatest(ceil(p/(0.4::DOUBLE/4)),1) AS nb FROM per),
occ AS (SELECT series_id, idx, p, nb, CAST(least(floor((tc/p-floor(tc/p))*nb), nb-1) AS BIGINT) AS b, sum(n) AS n, sum(s) AS s FROM cel, pb GROUP BY ALL),
wd AS (SELECT idx, d, CAST(greatest(floor(d*nb/p+0.5),1) AS BIGINT) AS k FROM pb, (VALUES (0.4::DOUBLE),(0.8::DOUBLE),(1.2::DOUBLE)) z(d) WHERE greatest(floor(d*nb/p+0.5),1)<nb),
win AS (SELECT series_id, o.idx, any_value(p) AS p, any_value(nb) AS nb, d, any_value(k) AS k, CAST((b-j+nb)%nb AS BIGINT) AS i, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS s FROM occ o JOIN (SELECT *, unnest(range(k)) AS j FROM wd) w ON w.idx=o.idx GROUP BY series_id, o.idx, d, CAST((b-j+nb)%nb AS BIGINT)),
dep AS (SELECT w.*, nn-n AS no, sigma, (CAST(ss-s AS DOUBLE)/(nn-n) - CAST(s AS DOUBLE)/n)/1000000000 AS depth FROM win w JOIN tot USING (series_id) JOIN sig USING (series_id) WHERE nn>n AND sigma>0),
bst AS (SELECT *, 0.5*n*depth*depth/(sigma*sigma) AS power FROM dep WHERE depth>0 QUALIFY row_number() OVER (PARTITION BY series_id, idx ORDER BY 0.5*n*depth*depth/(sigma*sigma) DESC, d, i)=1),
pg0 AS (SELECT t.series_id, t.idx, t.p AS period, coalesce(power,0) AS power, depth, sigma*sqrt(1.0/n+1.0/no) AS depth_err, depth/(sigma*sqrt(1.0/n+1.0/no)) AS snr, d AS duration, (i+k/2.0::DOUBLE)/nb*t.p AS epoch, n AS n_in
  FROM (SELECT sig.series_id, per.idx, per.p FROM sig, per WHERE sigma>0) t LEFT JOIN bst ON bst.series_id=t.series_id AND bst.idx=t.idx),
pg AS MATERIALIZED (SELECT *, (power - avg(power) OVER (PARTITION BY series_id))/stddev_pop(power) OVER (PARTITION BY series_id) AS sde FROM pg0)"""


def greedy_sql(source, count, clash):
    """SQL that takes the strongest point, then the strongest that does not clash with those taken."""
    out, taken = [], ""
    for k in range(1, count + 1):
        cond = f"WHERE NOT EXISTS (SELECT 1 FROM a{k - 1} c WHERE c.series_id=x.series_id AND ({clash}))" if k > 1 else ""
        out.append(f"g{k} AS MATERIALIZED (SELECT x.*, {k} AS rank FROM {source} x {cond} QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY power DESC, idx)=1)")
        taken = f"SELECT * FROM a{k - 1} UNION ALL SELECT * FROM g{k}" if k > 1 else "SELECT * FROM g1"
        out.append(f"a{k} AS MATERIALIZED ({taken})")
    return ", ".join(out)


def points(t):
    """Normalised points, written once: every search and diagnosis below reads them several times."""
    x = cleaning.normalise_parts(cleaning.quality_filter(t.obs())).filter("nv IS NOT NULL")
    return cut_lineage(x.select("series_id", "part_id", "seq", "t", F.col("nv").alias("y")))


def pgram(t):
    return pgram_of(points(t))


def pgram_of(pts):
    return bs.periodogram(pts, value="y", periods=GRID, durations=DURATIONS, oversample=OVERSAMPLE, cell_days=CELL)


def r(c, k=8):
    return F.round(c, k).alias(c)


@query("ts15_period_grid",
       """, s AS (SELECT series_id, (max(t)-min(t))/3 AS hi FROM obs GROUP BY 1) SELECT series_id, i AS idx, round(0.5::DOUBLE+(hi-0.5::DOUBLE)*i/49,8) AS linear_days, round(0.5::DOUBLE*pow(hi/0.5::DOUBLE, i/49.0::DOUBLE),8) AS log_days FROM s, range(50) r(i) WHERE hi>0.5""", "obs", "dummy AS (SELECT 1)")
def _(t):
    s = t.obs().groupBy("series_id").agg(((F.max("t") - F.min("t")) / 3).alias("hi")).filter("hi > 0.5")
    lo, hi = F.lit(0.5), F.col("hi")
    x = s.select("series_id", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(49)).alias("idx"), bs.linear_grid(lo, hi, 50).alias("lin"), bs.log_grid(lo, hi, 50).alias("log"))).alias("g"))
    return x.select("series_id", F.col("g.idx").cast("bigint").alias("idx"), F.round("g.lin", 8).alias("linear_days"), F.round("g.log", 8).alias("log_days"))


@query("ts16_box_search", "SELECT series_id, idx, round(period,8) AS period, round(power,6) AS power, round(depth,7) AS depth, round(depth_err,7) AS depth_err, round(snr,6) AS snr, duration, round(epoch,8) AS epoch, n_in, round(sde,6) AS sde FROM pg", "obs", PG)
def _(t):
    return pgram(t).select("series_id", "idx", r("period"), r("power", 6), r("depth", 7), r("depth_err", 7), r("snr", 6), "duration", r("epoch"), "n_in", r("sde", 6))


PEAKS = PG + ", " + greedy_sql("pg", 5, "abs(x.period/c.period-1)<0.02::DOUBLE")


def top_peaks(pg, count=5, separation=0.02):
    cols = ("idx", "period", "power", "depth", "depth_err", "snr", "duration", "epoch", "n_in", "sde")
    return pk.greedy_peaks(pg, ["series_id"], count, pk.relative_clash(separation), cols=cols)


@query("tk04_relative_peaks", "SELECT series_id, rank, idx, round(period,8) AS period, round(power,6) AS power FROM a5", "obs", PEAKS)
def _(t):
    return top_peaks(pgram(t)).select("series_id", "rank", "idx", r("period"), r("power", 6))


MAXIMA = ", mx AS MATERIALIZED (SELECT * FROM (SELECT *, lag(power) OVER w AS pl, lead(power) OVER w AS pr FROM pg WINDOW w AS (PARTITION BY series_id ORDER BY idx)) WHERE (pl IS NULL OR power>pl) AND (pr IS NULL OR power>=pr) AND (coalesce(power>pl,false) OR coalesce(power>pr,false)))"
CELLS = " OR ".join(["abs(x.idx-c.idx)<5"] + [f"(c.period*{m}>=(1.5::DOUBLE+(9.5::DOUBLE-1.5::DOUBLE)*greatest(x.idx-2,0)/79)-c.period*{m}*1e-9 AND c.period*{m}<=(1.5::DOUBLE+(9.5::DOUBLE-1.5::DOUBLE)*least(x.idx+2,79)/79)+c.period*{m}*1e-9)" for m in ("0.5::DOUBLE", "2.0::DOUBLE")])


@query("tk05_cell_and_harmonic_peaks", "SELECT series_id, rank, idx, round(power,6) AS power FROM a4", "obs", PG + MAXIMA + ", " + greedy_sql("mx", 4, CELLS))
def _(t):
    top = pk.local_maxima(pgram(t), ["series_id"], "idx", "power")
    sel = pk.greedy_peaks(top, ["series_id"], 4, pk.cell_clash(2, (0.5, 2.0), *GRID))
    return sel.select("series_id", "rank", "idx", r("power", 6))


@query("tk06_frequency_peaks", "SELECT series_id, rank, idx, round(greatest(1.5, period-greatest(0.015*period, 4*8.0/79)),6) AS slider_min, round(least(9.5, period+greatest(0.015*period, 4*8.0/79)),6) AS slider_max FROM a3", "obs",
       PG + MAXIMA.replace("AND (pr IS NULL OR power>=pr)", "AND (pr IS NULL OR power>=pr)") + ", " + greedy_sql("mx", 3, "abs(1/x.period-1/c.period)<1/30.0::DOUBLE"))
def _(t):
    top = pk.local_maxima(pgram(t), ["series_id"], "idx", "power")
    sel = pk.greedy_peaks(top, ["series_id"], 3, pk.frequency_clash(30.0))
    half = F.greatest(0.015 * F.col("period"), F.lit(4 * 8.0 / 79))
    return sel.select("series_id", "rank", "idx", F.round(F.greatest(F.lit(1.5), F.col("period") - half), 6).alias("slider_min"), F.round(F.least(F.lit(9.5), F.col("period") + half), 6).alias("slider_max"))


def gate_cols(transits=None):
    return pk.quality_gate("snr", "sde", transits, snr_min=3.0, sde_min=2.0)


@query("ts18_quality_gate", """SELECT series_id, idx, CASE WHEN snr IS NULL OR sde IS NULL THEN 'failed' WHEN snr<3 OR sde<2 THEN 'held' ELSE 'accepted' END AS status,
       CASE WHEN snr IS NULL OR sde IS NULL THEN 'non_finite_metric' ELSE concat_ws(',', CASE WHEN snr<3 THEN 'snr_below_threshold' END, CASE WHEN sde<2 THEN 'sde_below_threshold' END) END AS reasons FROM pg""", "obs", PG)
def _(t):
    status, reasons = gate_cols()
    return pgram(t).select("series_id", "idx", status.alias("status"), F.concat_ws(",", reasons).alias("reasons"))


def diagnosed(pts, peaks):
    """Peaks with observed transits, points and parts inside the window, and the gate's verdict."""
    near = pts.select("series_id", "part_id", "t").join(peaks.select("series_id", "rank", "period", "epoch", "duration"), "series_id").filter(
        in_window("t", F.col("period"), F.col("epoch"), F.col("duration")))
    seen = near.groupBy("series_id", "rank", "part_id", cycle("t", F.col("period"), F.col("epoch")).alias("c")).agg(F.count(F.lit(1)).alias("k"))
    diag = seen.groupBy("series_id", "rank").agg(F.sum("k").alias("n_in_transit"), F.count_distinct("c").alias("n_transits"), F.count_distinct("part_id").alias("n_parts"))
    x = peaks.join(diag, ["series_id", "rank"], "left").fillna(0, ["n_in_transit", "n_transits", "n_parts"])
    status, reasons = gate_cols(F.col("n_transits"))
    return x.withColumns({"status": status, "reasons": reasons})


@query("ts17_search_diagnostics",
       f""", d AS (SELECT a.series_id, a.rank, count(*) AS n_in_transit, count(DISTINCT floor((t-epoch)/period+0.5)) AS n_transits, count(DISTINCT part_id) AS n_parts FROM a5 a JOIN pts p ON p.series_id=a.series_id AND abs({dist('p.t', 'period', 'epoch')})<duration/2 GROUP BY ALL)
       SELECT a.series_id, a.rank, a.idx, coalesce(n_in_transit,0) AS n_in_transit, coalesce(n_transits,0) AS n_transits, coalesce(n_parts,0) AS n_parts, CASE WHEN snr IS NULL OR sde IS NULL THEN 'failed' WHEN snr<3 OR sde<2 OR coalesce(n_transits,0)<2 THEN 'held' ELSE 'accepted' END AS status FROM a5 a LEFT JOIN d USING (series_id, rank)""", "obs", PEAKS)
def _(t):
    pts = points(t)
    return diagnosed(pts, top_peaks(pgram(t))).select("series_id", "rank", "idx", "n_in_transit", "n_transits", "n_parts", "status")


@query("wn11_running_median_sde",
       """, e AS (SELECT series_id, idx, power, idx AS k FROM pg UNION ALL SELECT series_id, NULL, power, -1-idx FROM pg WHERE idx<10 UNION ALL SELECT series_id, NULL, power, 159-idx FROM pg WHERE idx>=70),
       m AS (SELECT series_id, idx, power - median(power) OVER (PARTITION BY series_id ORDER BY k ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS res FROM e), f AS (SELECT * FROM m WHERE idx IS NOT NULL)
       SELECT series_id, idx, round((res - avg(res) OVER w)/nullif(stddev_pop(res) OVER w,0),6) AS sde FROM f WINDOW w AS (PARTITION BY series_id)""", "obs", PG)
def _(t):
    return bs.running_median_sde(pgram(t), size=21).select("series_id", "idx", r("sde", 6))


@query("wn12_log_bin_sde",
       """, b AS (SELECT *, CAST(least(floor(ln(period/1.5::DOUBLE)/ln(9.5::DOUBLE/1.5::DOUBLE)*6),5) AS BIGINT) AS band FROM pg) SELECT series_id, idx, band, CASE WHEN count(*) OVER w>=8 THEN round((power - avg(power) OVER w)/nullif(stddev_pop(power) OVER w,0),6) END AS sde FROM b WINDOW w AS (PARTITION BY series_id, band)""", "obs", PG)
def _(t):
    return bs.log_bin_sde(pgram(t), bins=6, lo=1.5, hi=9.5, min_size=8).select("series_id", "idx", "band", r("sde", 6))


def refine_jobs(peaks, spacing, *, steps=2, n=201, n_durations=15):
    """A dense period grid around each peak and durations from half to twice its own, up to 0.35 P."""
    lo, hi = F.greatest(F.col("period") - steps * spacing, F.lit(GRID[0])), F.col("period") + steps * spacing
    d_hi = F.least(F.greatest(2 * F.col("duration"), F.lit(0.5)), 0.35 * F.col("period"))
    d_lo = F.least(0.5 * F.col("duration"), d_hi)
    return peaks.filter("duration IS NOT NULL").select("series_id", "rank", bs.linear_grid(lo, hi, n).alias("periods"), bs.linear_grid(d_lo, d_hi, n_durations).alias("durations"))


@query("ts19_peak_refinement")
def _(t):
    pts = points(t)
    inputs = bs.search_input(pts, value="y", cell_days=CELL)
    best = bs.box_search(inputs, refine_jobs(top_peaks(pgram(t), 1), 8.0 / 79), oversample=OVERSAMPLE)
    top = best.groupBy("series_id", "rank").agg(F.max_by(F.struct("period", "power", "depth", "snr", "duration", "epoch"), F.struct("power", -F.col("period"))).alias("b"))
    return top.select("series_id", "rank", "b.*")


MD = """md AS (SELECT series_id, m AS model_id, 2.1::DOUBLE+(series_id%5)*0.7::DOUBLE+m AS period, 0.3::DOUBLE*m AS epoch, 0.6::DOUBLE AS duration, 0.1::DOUBLE*m AS depth FROM (SELECT DISTINCT series_id FROM obs), (VALUES (1),(2)) z(m)),
pm AS (SELECT pts.*, md.model_id, md.period, md.epoch, md.duration, md.depth, """ + dist("t", "period", "epoch") + """ AS ph FROM pts JOIN md USING (series_id))"""
MODELS = PTS + ", " + MD


def models(t):
    """Two box models per series, from its id."""
    m = F.col("model_id")
    x = t.obs().select("series_id").distinct().withColumn("model_id", F.explode(F.array(F.lit(1), F.lit(2))))
    return x.withColumns({"period": F.lit(2.1) + (F.col("series_id") % 5) * 0.7 + m, "epoch": F.lit(0.3) * m, "duration": F.lit(0.6), "depth": F.lit(0.1) * m})


LOCAL = """, cel AS (SELECT series_id, (floor(t/0.02::DOUBLE)+0.5)*0.02::DOUBLE AS tc, count(*) AS n, CAST(sum(CAST(round(y*1000000000) AS BIGINT)) AS BIGINT) AS s FROM pts GROUP BY ALL), tot AS (SELECT series_id, CAST(sum(n) AS BIGINT) AS nn, CAST(sum(s) AS BIGINT) AS ss FROM cel GROUP BY 1),
jb AS (SELECT series_id, model_id, i AS idx, period*(1-0.02::DOUBLE)+(period*(1+0.02::DOUBLE)-period*(1-0.02::DOUBLE))*i/200 AS p, duration AS d FROM md, range(201) r(i)), jn AS (SELECT *, greatest(ceil(p/(d/4)),1) AS nb FROM jb), jk AS (SELECT *, CAST(greatest(floor(d*nb/p+0.5),1) AS BIGINT) AS k FROM jn),
oc AS (SELECT series_id, model_id, idx, k, nb, CAST(least(floor((tc/p-floor(tc/p))*nb), nb-1) AS BIGINT) AS b, sum(n) AS n, sum(s) AS s FROM jk JOIN cel USING (series_id) WHERE k<nb GROUP BY ALL),
wi AS (SELECT series_id, model_id, idx, CAST((b-j+nb)%nb AS BIGINT) AS i, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS s FROM (SELECT *, unnest(range(k)) AS j FROM oc) GROUP BY ALL),
dp AS (SELECT w.*, sigma, (CAST(ss-s AS DOUBLE)/(nn-n) - CAST(s AS DOUBLE)/n)/1000000000 AS depth FROM wi w JOIN tot USING (series_id) JOIN sig USING (series_id) WHERE nn>n AND sigma>0)
SELECT md.series_id, md.model_id, round(coalesce(max(0.5*n*dp.depth*dp.depth/(sigma*sigma)) FILTER (dp.depth>0),0),6) AS local_power FROM md LEFT JOIN dp USING (series_id, model_id) GROUP BY ALL"""


@query("ts22_local_max_power", LOCAL, "obs", MODELS)
def _(t):
    inputs = bs.search_input(points(t), value="y", cell_days=CELL)
    return it.local_power(inputs, models(t), ["series_id", "model_id"], oversample=OVERSAMPLE).select("series_id", "model_id", r("local_power", 6))


def on_models(t):
    return points(t).select("series_id", "part_id", "seq", "t", "y").join(models(t), "series_id")


KEYS = ["series_id", "model_id"]
PRODUCT = ", pr AS (SELECT series_id, seq, y, max(CASE WHEN model_id=1 AND abs(ph)<duration/2 THEN 1-depth ELSE 0 END) AS f1, max(CASE WHEN model_id=2 AND abs(ph)<duration/2 THEN 1-depth ELSE 0 END) AS f2 FROM pm GROUP BY ALL), mf AS (SELECT series_id, seq, y, CASE WHEN f1=0 THEN 1 ELSE f1 END * CASE WHEN f2=0 THEN 1 ELSE f2 END AS model FROM pr)"


@query("ts12_box_model", PRODUCT + " SELECT series_id, seq, round(model,8) AS model FROM mf", "obs", MODELS)
def _(t):
    return mo.with_model(points(t), models(t)).select("series_id", "seq", r("model"))


@query("ts13_model_removal", PRODUCT + " SELECT series_id, seq, round(y/model,8) AS residual, 'ok' AS removal_status FROM mf", "obs", MODELS)
def _(t):
    return mo.remove_models(points(t), models(t), value="y").select("series_id", "seq", r("residual"), "removal_status")


@query("ts14_residual_request")
def _(t):
    """A residual and its periodogram for every requested series."""
    res = mo.remove_models(points(t), models(t), value="y").filter("removal_status = 'ok'")
    return bs.periodogram(res, value="residual", periods=GRID, durations=DURATIONS, oversample=OVERSAMPLE, cell_days=CELL, spacing="log")


def sigma(t):
    return grouped_mad(points(t), "series_id", F.col("y"), median="m", scatter="sigma").drop("m")


@query("ts21_fixed_depth_snr", """SELECT series_id, model_id, n_in, n_out, round(o-i,6) AS fit_depth, round((o-i)/(sigma*sqrt(1.0/n_in+1.0/n_out)),6) AS fit_snr FROM (SELECT series_id, model_id, count(*) FILTER (abs(ph)<duration/2) AS n_in, count(*) FILTER (NOT abs(ph)<duration/2) AS n_out, avg(y) FILTER (abs(ph)<duration/2) AS i, avg(y) FILTER (NOT abs(ph)<duration/2) AS o FROM pm GROUP BY ALL) JOIN sig USING (series_id)""", "obs", MODELS)
def _(t):
    return mo.fixed_depth(on_models(t), KEYS, sigma(t), value="y").select(*KEYS, "n_in", "n_out", r("fit_depth", 6), r("fit_snr", 6))


RQ = """, c AS (SELECT series_id, model_id, count(*) FILTER (abs(ph)<duration/2) AS n_in, count(*) FILTER (abs(ph)>=duration/2 AND abs(ph)<duration) AS n_edge, count(*) FILTER (abs(ph)>=duration) AS n_out, avg(y-1) FILTER (abs(ph)<duration/2) AS mi, avg(y-1) FILTER (abs(ph)>=duration) AS mo,
 median(abs(y-1)) FILTER (abs(ph)>=duration/2 AND abs(ph)<duration) AS ed, median(y) FILTER (abs(ph)>=duration) AS om FROM pm GROUP BY ALL), s AS (SELECT pm.series_id, pm.model_id, 1.4826*median(abs(y-om)) AS sc FROM pm JOIN c USING (series_id, model_id) WHERE abs(ph)>=duration GROUP BY ALL), j AS (SELECT * FROM c JOIN s USING (series_id, model_id))"""


@query("ts23_edge_excess", RQ + " SELECT series_id, model_id, n_edge, CASE WHEN n_out>=20 AND n_edge>=5 AND sc>0 THEN round(ed/sc,7) END AS edge_excess FROM j", "obs", MODELS)
def _(t):
    return mo.residual_quality(on_models(t), KEYS, value="y").select(*KEYS, "n_edge", r("edge_excess", 7))


@query("ts24_window_offset", RQ + " SELECT series_id, model_id, CASE WHEN n_out>=20 AND n_in>=5 AND sc>0 THEN round(mi/(sc/sqrt(n_in)),6) END AS offset_z, CASE WHEN n_out>=20 AND n_in>=5 AND sc>0 THEN round((mi-mo)/(sc*sqrt(1.0/n_in+1.0/n_out)),6) END AS offset_z_out FROM j", "obs", MODELS)
def _(t):
    return mo.residual_quality(on_models(t), KEYS, value="y").select(*KEYS, r("offset_z", 6), r("offset_z_out", 6))


def other_window(t):
    """For each point and model, whether the series' other model covers it."""
    return (F.col("model_id") == 1) & in_window("t", F.lit(2.1) + (F.col("series_id") % 5) * 0.7 + 2, F.lit(0.6), F.lit(0.6))


@query("ts25_overlap_metrics",
       f""", b AS (SELECT *, abs(ph)<duration/2 AS mine, model_id=1 AND abs({dist('t', '(2.1::DOUBLE+(series_id%5)*0.7::DOUBLE+2)', '0.6::DOUBLE')})<0.6::DOUBLE/2 AS other FROM pm), g AS (SELECT series_id, model_id, count(*) FILTER (mine) AS nm, count(*) FILTER (mine AND other) AS nb, median(abs(y-1)) FILTER (mine AND other) AS dv FROM b GROUP BY ALL)
       SELECT series_id, model_id, round(coalesce(nb*1.0/nullif(nm,0),0),8) AS overlap_fraction, CASE WHEN nb>=3 AND sigma>0 THEN round(dv/sigma,7) END AS overlap_dev FROM g JOIN sig USING (series_id)""", "obs", MODELS)
def _(t):
    return mo.overlap(on_models(t), KEYS, other_window(t), value="y").select(*KEYS, r("overlap_fraction"), r("overlap_dev", 7))


def _power_sql(of, tag):
    """CTEs w{tag} (series_id, power): the largest local power of model 1 on column ``of`` of the table q."""
    return f""", s{tag} AS (SELECT q.series_id, count(*) AS np, 1.4826*median(abs({of}-m)) AS sigma FROM q JOIN (SELECT series_id, median({of}) AS m FROM q GROUP BY ALL) USING (series_id) GROUP BY q.series_id),
cel{tag} AS (SELECT series_id, (floor(t/0.02::DOUBLE)+0.5)*0.02::DOUBLE AS tc, count(*) AS n, CAST(sum(CAST(round({of}*1000000000) AS BIGINT)) AS BIGINT) AS s FROM q GROUP BY ALL), tot{tag} AS (SELECT series_id, CAST(sum(n) AS BIGINT) AS nn, CAST(sum(s) AS BIGINT) AS ss FROM cel{tag} GROUP BY 1),
oc{tag} AS (SELECT series_id, idx, k, nb, CAST(least(floor((tc/p-floor(tc/p))*nb), nb-1) AS BIGINT) AS b, sum(n) AS n, sum(s) AS s FROM jk JOIN cel{tag} USING (series_id) WHERE k<nb GROUP BY ALL),
wi{tag} AS (SELECT series_id, idx, CAST((b-j+nb)%nb AS BIGINT) AS i, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS s FROM (SELECT *, unnest(range(k)) AS j FROM oc{tag}) GROUP BY ALL),
w{tag} AS (SELECT series_id, coalesce(max(0.5*n*dp*dp/(sigma*sigma)) FILTER (dp>0), 0) AS power FROM (SELECT w.*, sigma, (CAST(ss-s AS DOUBLE)/(nn-n) - CAST(s AS DOUBLE)/n)/1000000000 AS dp FROM wi{tag} w JOIN tot{tag} USING (series_id) JOIN s{tag} USING (series_id) WHERE nn>n AND sigma>0) GROUP BY ALL)"""


QA_MIN_POINTS = 30
QA_SQL = (f""", q AS (SELECT p.series_id, p.t, p.y AS v0, {dist('p.t', 'a.period', 'a.epoch')} AS ph, {dist('p.t', 'b.period', 'b.epoch')} AS ph2, a.duration, b.duration AS d2, a.depth,
  p.y/(CASE WHEN abs({dist('p.t', 'b.period', 'b.epoch')})<b.duration/2 THEN 1-b.depth ELSE 1 END) AS cur, p.y/(CASE WHEN abs({dist('p.t', 'a.period', 'a.epoch')})<a.duration/2 THEN 1-a.depth ELSE 1 END) AS r0,
  p.y/(CASE WHEN abs({dist('p.t', 'b.period', 'b.epoch')})<b.duration/2 THEN 1-b.depth ELSE 1 END)/(CASE WHEN abs({dist('p.t', 'a.period', 'a.epoch')})<a.duration/2 THEN 1-a.depth ELSE 1 END) AS res
  FROM pts p JOIN md a ON a.series_id=p.series_id AND a.model_id=1 JOIN md b ON b.series_id=p.series_id AND b.model_id=2),
pq AS (SELECT series_id, 1 AS model_id, ph, duration, depth, res AS y FROM q)""" + RQ.replace("pm", "pq") + """,
jb AS (SELECT series_id, i AS idx, period*(1-0.02::DOUBLE)+(period*(1+0.02::DOUBLE)-period*(1-0.02::DOUBLE))*i/200 AS p, duration AS d FROM md, range(201) r(i) WHERE model_id=1), jn AS (SELECT *, greatest(ceil(p/(d/4)),1) AS nb FROM jb), jk AS (SELECT *, CAST(greatest(floor(d*nb/p+0.5),1) AS BIGINT) AS k FROM jn)"""
          + _power_sql("cur", "b") + _power_sql("res", "a") + f""",
ot AS (SELECT series_id, count(r0) AS n0, avg(v0) FILTER (NOT abs(ph2)<d2/2) - avg(v0) FILTER (abs(ph2)<d2/2) AS da, avg(r0) FILTER (NOT abs(ph2)<d2/2) - avg(r0) FILTER (abs(ph2)<d2/2) AS db,
  count(*) FILTER (abs(ph)<duration/2 AND abs(ph2)<d2/2) AS nb, median(abs(res-1)) FILTER (abs(ph)<duration/2 AND abs(ph2)<d2/2) AS dv, count(cur) AS nv, count(res) AS nr FROM q GROUP BY ALL),
al AS (SELECT m.series_id, nv, nr, CASE WHEN wb.power>0 AND sa.np>={QA_MIN_POINTS} THEN wa.power/wb.power END AS ratio, CASE WHEN n_out>=20 AND n_edge>=5 AND sc>0 THEN ed/sc END AS ee, CASE WHEN n0>={QA_MIN_POINTS} AND da>0 AND db>0 THEN abs(log2(da)-log2(db)) END AS lg,
  CASE WHEN ot.nb>=3 AND sa.sigma>0 THEN dv/sa.sigma END AS od, CASE WHEN n_out>=20 AND n_in>=5 AND sc>0 THEN mi/(sc/sqrt(n_in)) END AS wz, CASE WHEN n_out>=20 AND n_in>=5 THEN mi/m.depth END AS wr
  FROM md m LEFT JOIN ot USING (series_id) LEFT JOIN j ON j.series_id=m.series_id LEFT JOIN wa ON wa.series_id=m.series_id LEFT JOIN wb ON wb.series_id=m.series_id LEFT JOIN sa ON sa.series_id=m.series_id WHERE m.model_id=1)
SELECT series_id, concat_ws(',', CASE WHEN nr<>nv THEN 'non_finite' END, CASE WHEN NOT coalesce(ratio<=0.5, false) THEN 'power_not_reduced' END, CASE WHEN ee>0.7 THEN 'edge_excess' END, CASE WHEN lg IS NULL THEN 'other_depth_not_measurable' END,
  CASE WHEN lg>0.5 THEN 'other_candidate_damaged' END, CASE WHEN od>1.5 THEN 'overlap_distortion' END, CASE WHEN ee IS NULL OR wz IS NULL THEN 'qa_not_measurable' END, CASE WHEN abs(wz)>1 AND NOT coalesce(abs(wr)<=0.1, false) THEN 'window_offset' END) AS failures,
  round(ratio,6) AS power_ratio, round(ee,6) AS edge_excess, round(lg,6) AS other_depth_log2_max, round(od,6) AS overlap_dev, round(wz,5) AS window_offset_z, round(wr,6) AS window_offset_rel FROM al""")


@query("ts26_removal_quality_verdict", QA_SQL, "obs", MODELS)
def _(t):
    """All eight checks of dividing out the first model of each series, the second being accepted already."""
    m = models(t)
    second = m.filter("model_id = 2").select("series_id", F.array(F.struct(F.lit(0).alias("step"), *mo.MODEL)).alias("others"))
    first = m.filter("model_id = 1").select("series_id", *mo.MODEL).join(second, "series_id")
    pts = points(t).select("series_id", "t", F.col("y").alias("v0")).join(second, "series_id")
    pts = pts.select("series_id", "t", "v0", (F.col("v0") / mo.product_of(F.col("others"), F.col("t"))).alias("v"))
    x = it.removal_measures(pts, first, oversample=OVERSAMPLE, cell_days=CELL, min_points=QA_MIN_POINTS)
    # Limits at which every check fails for some series of the tables.
    limits = it.RemovalLimits(edge_excess=0.7, other_log2=0.5, overlap=1.5, offset_z=1.0)
    return x.select("series_id", F.concat_ws(",", it.removal_failures(limits)).alias("failures"), r("power_ratio", 6), r("edge_excess", 6), r("other_depth_log2_max", 6),
                    r("overlap_dev", 6), r("window_offset_z", 5), r("window_offset_rel", 6))


@query("ts27_harmonic_duplicates",
       f""", tr AS (SELECT a.series_id, a.rank, count(DISTINCT floor((t-epoch)/period+0.5)) AS nt FROM a5 a JOIN pts p ON p.series_id=a.series_id AND abs({dist('p.t', 'period', 'epoch')})<duration/2 GROUP BY ALL),
       an AS (SELECT a5.*, greatest(coalesce(nt,0),1) AS nt FROM a5 LEFT JOIN tr USING (series_id, rank)),
       c AS (SELECT a.series_id, a.rank, b.rank AS with_rank FROM an a JOIN an b ON a.series_id=b.series_id AND b.rank<a.rank AND (abs(a.period-0.5::DOUBLE*b.period)*a.nt<=greatest(a.duration,b.duration)/2 OR abs(a.period-b.period)*a.nt<=greatest(a.duration,b.duration)/2 OR abs(a.period-2.0::DOUBLE*b.period)*a.nt<=greatest(a.duration,b.duration)/2))
       SELECT a.series_id, a.rank, a.nt AS n_transits, min(with_rank) AS duplicate_of FROM an a LEFT JOIN c USING (series_id, rank) GROUP BY ALL""", "obs", PEAKS)
def _(t):
    """The first better peak that each peak repeats, by its own observed events."""
    pts = points(t)
    p = it._transits(pts, top_peaks(pgram(t))).withColumn("n_transits", F.greatest("n_transits", F.lit(1))).select("series_id", "rank", "period", "duration", "n_transits")
    p = cut_lineage(p)
    b = p.select("series_id", F.col("rank").alias("with_rank"), F.col("period").alias("p2"), F.col("duration").alias("d2"))
    # Five peaks per series at most, so the pairs are bounded by ten.
    hit = p.join(b, "series_id").filter((F.col("with_rank") < F.col("rank")) & it.harmonic_duplicate("period", "duration", F.col("n_transits"), "p2", "d2"))
    return p.select("series_id", "rank", "n_transits").join(hit.groupBy("series_id", "rank").agg(F.min("with_rank").alias("duplicate_of")), ["series_id", "rank"], "left")


@query("ts28_parity_and_secondary_depth",
       """, k AS (SELECT *, abs(ph)<duration/2 AS pri, abs(abs(ph)-period/2)<duration/2 AS sec, round_even((t-epoch)/period,0)::BIGINT AS c FROM pm), z AS (SELECT *, ((c%2)+2)%2=1 AS odd FROM k),
       d AS (SELECT series_id, model_id, median(y) FILTER (NOT pri AND NOT sec) AS o, median(y) FILTER (pri) AS p, median(y) FILTER (sec AND NOT pri) AS s, median(y) FILTER (pri AND odd) AS od, median(y) FILTER (pri AND NOT odd) AS ev FROM z GROUP BY ALL),
       m AS (SELECT z.series_id, z.model_id, 1.4826*median(abs(y-o)) AS sc FROM z JOIN d USING (series_id, model_id) WHERE NOT pri AND NOT sec GROUP BY ALL)
       SELECT series_id, model_id, round(o-p,8) AS primary_depth, round(o-s,8) AS secondary_depth, round(o-od,8) AS odd_depth, round(o-ev,8) AS even_depth, round(sc,8) AS outside_scatter FROM d LEFT JOIN m USING (series_id, model_id)""", "obs", MODELS)
def _(t):
    x = mo.parity_depths(on_models(t), KEYS, value="y")
    return x.select(*KEYS, r("primary_depth"), r("secondary_depth"), r("odd_depth"), r("even_depth"), r("outside_scatter"))


@query("ts29_cycle_depths",
       """, k AS (SELECT *, round_even((t-(epoch+period/2))/period,0) AS c FROM pm), e AS (SELECT *, abs(t-((epoch+period/2)+c*period)) AS dl FROM k)
       SELECT series_id, model_id, CAST(c AS BIGINT) AS cyc, count(*) FILTER (dl<duration/2) AS n_in, count(*) FILTER (dl>=2*(duration/2) AND dl<4*(duration/2)) AS n_base, round(median(y) FILTER (dl>=2*(duration/2) AND dl<4*(duration/2)) - median(y) FILTER (dl<duration/2),8) AS depth FROM e GROUP BY series_id, model_id, c""", "obs", MODELS)
def _(t):
    return mo.cycle_depths(on_models(t), KEYS, value="y").select(*KEYS, "cyc", "n_in", "n_base", r("depth"))


WIDE = f"abs({dist('t', '3.1::DOUBLE', '0.4::DOUBLE')})<1.0::DOUBLE/2"


@query("ts30_two_window_joint_depth",
       f""", w AS (SELECT series_id, y, abs({dist('t', '2.3::DOUBLE', '0.2::DOUBLE')})<0.8::DOUBLE/2 AS a, {WIDE} AS b FROM pts), g AS (SELECT series_id, count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only, count(*) FILTER (a AND b) AS both_, count(*) FILTER (NOT a AND NOT b) AS outside,
       CAST(count(*) AS DOUBLE) AS n, sum(y) AS sy, coalesce(sum(y) FILTER (a),0) AS ya, coalesce(sum(y) FILTER (b),0) AS yb FROM w GROUP BY 1),
       q AS (SELECT *, (a_only+both_)-(a_only+both_)*(a_only+both_)/n AS saa, (b_only+both_)-(b_only+both_)*(b_only+both_)/n AS sbb, both_-(a_only+both_)*(b_only+both_)/n AS sab, ya-(a_only+both_)*sy/n AS say, yb-(b_only+both_)*sy/n AS sby FROM g), d AS (SELECT *, saa*sbb-sab*sab AS det FROM q)
       SELECT series_id, a_only, b_only, both_ AS both, outside, CASE WHEN outside=0 OR n<4 THEN 'not_measurable' WHEN NOT det>1e-9*greatest(saa*sbb,1e-9) THEN 'unidentifiable' ELSE 'measured' END AS status, CASE WHEN det>1e-9*greatest(saa*sbb,1e-9) THEN round(-(say*sbb-sby*sab)/det,6) END AS depth_a, CASE WHEN det>1e-9*greatest(saa*sbb,1e-9) THEN round(-(sby*saa-say*sab)/det,6) END AS depth_b FROM d""", "obs", PTS)
def _(t):
    x = mo.joint_depths(points(t), ["series_id"], in_window("t", 2.3, 0.2, 0.8), in_window("t", 3.1, 0.4, 1.0), value="y")
    return x.select("series_id", "a_only", "b_only", "both", "outside", "status", r("depth_a", 6), r("depth_b", 6))


@query("ts32_local_depth",
       """, l AS (SELECT *, CASE WHEN abs(ph)<duration/2 THEN 'i' WHEN abs(ph)>=duration AND abs(ph)<least(2*duration, period/2) THEN 'o' END AS cls FROM pm)
       SELECT series_id, model_id, count(*) FILTER (cls='i') AS n_in, count(*) FILTER (cls='o') AS n_out, CASE WHEN count(*) FILTER (cls='i')>=3 AND count(*) FILTER (cls='o')>=3 THEN round(median(y) FILTER (cls='o')-median(y) FILTER (cls='i'),8) END AS depth FROM l WHERE cls IS NOT NULL GROUP BY ALL""", "obs", MODELS)
def _(t):
    return mo.local_depth(on_models(t), KEYS, value="y").select(*KEYS, "n_in", "n_out", r("depth"))


@query("ts44_folded_window_statistics",
       """, f AS (SELECT series_id, y, t/2.5-floor(t/2.5) AS p FROM pts), w AS (SELECT *, (p>=0.8 AND p<=1.1) OR (p+1>=0.8 AND p+1<=1.1) OR (p-1>=0.8 AND p-1<=1.1) AS inside FROM f)
       SELECT series_id, count(*) FILTER (inside) AS n_in, count(*) FILTER (NOT inside) AS n_out, round((avg(y) FILTER (NOT inside)-avg(y) FILTER (inside))/nullif(avg(y) FILTER (NOT inside),0),6) AS rel_depth FROM w GROUP BY 1""", "obs", PTS)
def _(t):
    turns = F.col("t") / 2.5
    p = turns - F.floor(turns)
    inside = p.between(0.8, 1.1) | (p + 1).between(0.8, 1.1) | (p - 1).between(0.8, 1.1)
    x = points(t).withColumn("i", inside).groupBy("series_id").agg(F.count_if("i").alias("n_in"), F.count_if(~F.col("i")).alias("n_out"), F.avg(F.when(F.col("i"), F.col("y"))).alias("a"), F.avg(F.when(~F.col("i"), F.col("y"))).alias("b"))
    return x.select("series_id", "n_in", "n_out", F.round(F.try_divide(F.col("b") - F.col("a"), F.col("b")), 6).alias("rel_depth"))


@query("ts20_iterative_search")
def _(t):
    steps = it.iterate(points(t).select("series_id", "part_id", "seq", "t", F.col("y").alias("v")), periods=GRID, durations=DURATIONS, oversample=OVERSAMPLE,
                       cell_days=CELL, snr_min=3.0, sde_min=2.0, min_points=30)
    return steps
