"""Catalogue matching, identity, injections and evaluation of recoveries."""

import re

from pyspark.sql import functions as F

from phasemill.functions.hashing import record_set_digest
from phasemill.functions.phase import in_window
from phasemill.functions.scalars import to_btjd
from phasemill.operators import boxsearch as bs, cleaning, identity as idt, matching as mt, models as mo
from phasemill.operators.contracts import first_reason
from phasemill.operators.discover import critical, discoverable, noise_series, paired_blocks, prefix_run
from phasemill.operators.medians import grouped_mad, grouped_median
from phasemill.operators.ordered import latest
from phasemill.plans import search as se
from phasemill.plans.registry import query, set_digest_sql
from phasemill.plans.series import BINNED
from phasemill.plans.relational import EVENTS_OF, observed
from phasemill.session import cut_lineage

D = "dummy AS (SELECT 1)"
COLS = ["series_id", "cid", "period", "epoch", "duration", "depth", "score"]


def side(name, kind):
    return f"""{name} AS (SELECT user_id AS series_id, event_id AS cid, 2.0::DOUBLE+k%4 AS period, floor(t*2)/2 AS epoch, 0.5::DOUBLE+0.25::DOUBLE*(k%2) AS duration, (1+k%3)/8.0::DOUBLE AS depth, value AS score
 FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, CAST(epoch_us(ts) AS DOUBLE)/CAST(86400000000 AS DOUBLE) - 19723 AS t FROM events WHERE event_type='{kind}'))"""


def signals(t, kind):
    """Every signal of each series."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    days = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / F.lit(86400000000.0) - F.lit(19723.0)
    return t.events.filter(F.col("event_type") == kind).withColumns({"k": k, "d": days}).select(
        F.col("user_id").alias("series_id"), F.col("event_id").alias("cid"), (F.lit(2.0) + F.col("k") % 4).alias("period"), (F.floor(F.col("d") * 2) / 2).alias("epoch"),
        (F.lit(0.5) + F.lit(0.25) * (F.col("k") % 2)).alias("duration"), ((1 + F.col("k") % 3) / F.lit(8.0)).alias("depth"), F.col("value").alias("score"))


def one_sided(p, e, q, f):
    near = f"({e}+floor((15.0::DOUBLE-{e})/{p}+0.5)*{p})"
    other = f"({f}+floor(({near}-{f})/{q}+0.5)*{q})"
    return f"(abs({near}-{other})+ceil(greatest(abs(0-{near}),abs(30-{near}))/least({p},{q}))*abs({p}-{q}))"


DIST = f"greatest({one_sided('a.period', 'a.epoch', 'b.period', 'b.epoch')},{one_sided('b.period', 'b.epoch', 'a.period', 'a.epoch')})/least(a.duration,b.duration)"
MULT = "list_filter([0.25::DOUBLE, 1/3.0::DOUBLE, 0.5, 2.0, 3.0, 4.0], lambda m: least(abs(a.period-b.period/m)*ceil(30.0/least(a.period,b.period/m)), abs(b.period-a.period*m)*ceil(30.0/least(b.period,a.period*m)))<=0.5*least(a.duration,b.duration))"
PAIRS = f"{side('sa', 'purchase')},\n{side('sb', 'signup')},\npp AS (SELECT a.series_id, a.cid AS a_cid, b.cid AS b_cid, a.period AS ap, a.epoch AS ae, a.duration AS ad, b.period AS bp, b.epoch AS be, b.duration AS bd, {DIST} AS dist, {MULT} AS mult FROM sa a JOIN sb b ON a.series_id=b.series_id)"


def both(t):
    return signals(t, "purchase"), signals(t, "signup")


@query("id01_ephemeris_distance", "SELECT series_id, a_cid, b_cid, round(dist,8) AS dist FROM pp", ctes=PAIRS)
def _(t):
    return idt.pairs(*both(t), 0.0, 30.0, 0.5).select("series_id", "a_cid", "b_cid", F.round("dist", 8).alias("dist"))


@query("id02_alias_multipliers", "SELECT series_id, a_cid, b_cid, list_aggregate(list_transform(mult, lambda m: CAST(CAST(round(m*12) AS BIGINT) AS VARCHAR)), 'string_agg', ',') AS twelfths FROM pp WHERE len(mult)>0", ctes=PAIRS)
def _(t):
    p = idt.near_pairs(*both(t), 0.0, 30.0, 0.5).filter(F.size("multipliers") > 0)
    return p.select("series_id", "a_cid", "b_cid", F.concat_ws(",", F.transform("multipliers", lambda m: F.round(m * 12).cast("bigint").cast("string"))).alias("twelfths"))


RECON = """, e AS (SELECT *, count(*) OVER (PARTITION BY series_id, a_cid) AS da, count(*) OVER (PARTITION BY series_id, b_cid) AS db FROM pp WHERE dist<=0.5), am AS (SELECT series_id, bool_or(da>1 OR db>1) AS amb, count(*) AS ne FROM e GROUP BY 1),
al AS (SELECT pp.series_id, bool_or(len(mult)>0) AS alias FROM pp WHERE NOT ((series_id, a_cid) IN (SELECT (series_id, a_cid) FROM e) AND (series_id, b_cid) IN (SELECT (series_id, b_cid) FROM e)) GROUP BY 1),
sz AS (SELECT series_id, count(*) FILTER (s=0) AS n_old, count(*) FILTER (s=1) AS n_new FROM (SELECT series_id, 0 AS s FROM sa UNION ALL SELECT series_id, 1 FROM sb) GROUP BY 1),
rc AS (SELECT series_id, CASE WHEN coalesce(amb,false) THEN 'ambiguous' WHEN coalesce(alias,false) THEN 'possible_alias' ELSE 'resolved' END AS status, n_old, n_new, coalesce(ne,0) AS ne FROM sz LEFT JOIN am USING (series_id) LEFT JOIN al USING (series_id))"""


@query("id03_reconcile", RECON + " SELECT series_id, status, CASE WHEN status='resolved' THEN ne ELSE 0 END AS matched, CASE WHEN status='resolved' THEN n_new-ne ELSE 0 END AS added, CASE WHEN status='resolved' THEN n_old-ne ELSE 0 END AS retired FROM rc", ctes=PAIRS)
def _(t):
    return idt.reconcile(*both(t), 0.0, 30.0, 0.5)


@query("id04_pair_review", "SELECT series_id, a_cid, b_cid, CASE WHEN dist<=0.5 THEN 'direct_overlap' ELSE 'possible_alias' END AS relation, round(dist,8) AS dist FROM pp WHERE a_cid<b_cid AND (dist<=0.5 OR len(mult)>0)", ctes=PAIRS.replace(side("sb", "signup"), side("sb", "purchase")))
def _(t):
    return idt.review(signals(t, "purchase"), 0.0, 30.0, 0.5).select("series_id", "a_cid", "b_cid", "relation", F.round("dist", 8).alias("dist"))


@query("id04_representative", "SELECT series_id, arg_min(cid, (-score, cid)) AS representative, count(*) FILTER (score=top)>1 AS tie FROM sa JOIN (SELECT series_id, max(score) AS top FROM sa GROUP BY 1) USING (series_id) GROUP BY series_id", ctes=side("sa", "purchase"))
def _(t):
    return idt.representative(signals(t, "purchase"))


@query("id05_exact_model_groups", "SELECT series_id, period, duration, depth, epoch-floor(epoch/period)*period AS base_epoch, min(cid) AS representative, count(*)-1 AS duplicates FROM sa GROUP BY 1,2,3,4,5", ctes=side("sa", "purchase"))
def _(t):
    return idt.exact_groups(signals(t, "purchase"))


@query("id06_lifecycle_proposal", RECON + """, ac AS (SELECT series_id, a_cid AS old_cid, b_cid AS new_cid, 'keep' AS action FROM e UNION ALL SELECT series_id, cid, NULL, 'retire' FROM sa WHERE (series_id, cid) NOT IN (SELECT (series_id, a_cid) FROM e) UNION ALL SELECT series_id, NULL, cid, 'add' FROM sb WHERE (series_id, cid) NOT IN (SELECT (series_id, b_cid) FROM e))
 SELECT DISTINCT series_id, old_cid, new_cid, CASE WHEN status<>'resolved' THEN 'hold' ELSE action END AS action, CASE WHEN status<>'resolved' THEN status END AS reason FROM ac JOIN rc USING (series_id)""", ctes=PAIRS)
def _(t):
    return idt.lifecycle(*both(t), 0.0, 30.0, 0.5)


EXPORT = """ex AS (SELECT 'orders' AS source, CAST(o_custkey AS VARCHAR) AS entity, 'o' || o_orderkey AS external_id, o_totalprice/10000 AS period, o_totalprice AS raw_epoch, CASE o_orderstatus WHEN 'O' THEN 'BTJD-TDB' WHEN 'F' THEN 'BJD-TDB' ELSE 'HJD' END AS scale, o_orderpriority AS label FROM orders
 UNION ALL SELECT 'supplier', CAST(s_nationkey AS VARCHAR), s_name, s_acctbal/1000, s_acctbal, 'BTJD-TDB', NULL FROM supplier UNION ALL SELECT 'part', CAST(p_size AS VARCHAR), p_brand || '-' || p_partkey, p_retailprice/100, p_retailprice, 'BJD-UTC', p_type FROM part UNION ALL SELECT 'customer', CAST(c_nationkey AS VARCHAR), c_name, c_acctbal/1000, c_acctbal, 'BTJD-TDB', c_mktsegment FROM customer),
nx AS (SELECT source, entity, external_id, round(period,6) AS period, round(CASE scale WHEN 'BTJD-TDB' THEN raw_epoch WHEN 'BJD-TDB' THEN raw_epoch-2457000.0 WHEN 'BJD-UTC' THEN raw_epoch+69.184::DOUBLE/86400-2457000.0 END,6) AS epoch, label, CASE WHEN scale='HJD' THEN 'unverified_time_standard' WHEN NOT period>0 THEN 'invalid_period' WHEN label='PROMO' THEN 'excluded' END AS reason FROM ex)"""


def exports(t):
    """Four layouts as one schema, with the reason a row is held."""
    text = lambda c: F.col(c).cast("string")
    rows = lambda df, source, entity, ident, period, raw, scale, label: df.select(
        F.lit(source).alias("source"), entity.alias("entity"), ident.alias("external_id"), period.alias("period"), raw.alias("raw_epoch"), scale.alias("scale"), label.cast("string").alias("label"))
    o = F.when(F.col("o_orderstatus") == "O", "BTJD-TDB").when(F.col("o_orderstatus") == "F", "BJD-TDB").otherwise("HJD")
    x = (rows(t.orders, "orders", text("o_custkey"), F.concat(F.lit("o"), "o_orderkey"), F.col("o_totalprice") / 10000, F.col("o_totalprice"), o, F.col("o_orderpriority"))
         .unionByName(rows(t.supplier, "supplier", text("s_nationkey"), F.col("s_name"), F.col("s_acctbal") / 1000, F.col("s_acctbal"), F.lit("BTJD-TDB"), F.lit(None)))
         .unionByName(rows(t.part, "part", text("p_size"), F.concat("p_brand", F.lit("-"), "p_partkey"), F.col("p_retailprice") / 100, F.col("p_retailprice"), F.lit("BJD-UTC"), F.col("p_type")))
         .unionByName(rows(t.customer, "customer", text("c_nationkey"), F.col("c_name"), F.col("c_acctbal") / 1000, F.col("c_acctbal"), F.lit("BTJD-TDB"), F.col("c_mktsegment"))))
    epoch = to_btjd(F.col("raw_epoch"), F.col("scale"))
    reason = first_reason([("unverified_time_standard", epoch.isNull()), ("invalid_period", ~(F.col("period") > 0)), ("excluded", F.col("label") == "PROMO")])
    return x.select("source", "entity", "external_id", F.round("period", 6).alias("period"), F.round(epoch, 6).alias("epoch"), "label", reason.alias("reason"))


@query("id07_export_normalisation", "SELECT * FROM nx", ctes=EXPORT)
def _(t):
    return exports(t)


@query("id08_snapshot_build", ", d AS (SELECT source, entity, external_id, count(*) AS c FROM nx GROUP BY ALL), e AS (SELECT source, entity, CAST(sum(c-1) AS BIGINT) AS n_duplicates FROM d GROUP BY ALL), g AS (SELECT source, entity, count(*) AS n_ok, " + set_digest_sql("""'{"entity":"' || entity || '","external_id":"' || external_id || '","source":"' || source || '"}'""") + " AS digest FROM nx WHERE reason IS NULL GROUP BY ALL) SELECT source, entity, coalesce(n_ok,0) AS n_ok, n_duplicates, digest FROM e LEFT JOIN g USING (source, entity)", ctes=EXPORT)
def _(t):
    x = exports(t).select("source", "entity", "external_id", "reason")
    copies = x.groupBy("source", "entity", "external_id").agg(F.count(F.lit(1)).alias("c")).groupBy("source", "entity").agg(F.sum(F.col("c") - 1).alias("n_duplicates"))
    d = record_set_digest(x.filter("reason IS NULL"), ["source", "entity"], ["source", "entity", "external_id"])
    return copies.join(d, ["source", "entity"], "left").select("source", "entity", F.coalesce("n_rows", F.lit(0)).alias("n_ok"), "n_duplicates", "digest")


MATCH = f""", ob AS (SELECT series_id, t FROM obs WHERE q=0), nr AS (SELECT * FROM pp WHERE dist<=0.5 AND greatest(ad,bd)/least(ad,bd)<=2),
sh AS (SELECT nr.series_id, a_cid, b_cid, count(*) FILTER (abs({se.dist('t', 'ap', 'ae')})<ad/2 AND abs({se.dist('t', 'bp', 'be')})<bd/2) AS s, count(*) FILTER (abs({se.dist('t', 'ap', 'ae')})<ad/2 OR abs({se.dist('t', 'bp', 'be')})<bd/2) AS u FROM nr JOIN ob USING (series_id) GROUP BY ALL),
ed AS (SELECT *, count(*) OVER (PARTITION BY series_id, a_cid) AS da, count(*) OVER (PARTITION BY series_id, b_cid) AS db FROM sh WHERE s>=1 AND s*1.0/u>=0.5), ma AS (SELECT series_id, b_cid, bool_or(da>1 OR db>1) AS amb, min(a_cid) AS m FROM ed GROUP BY ALL),
alx AS (SELECT DISTINCT series_id, b_cid FROM pp WHERE len(mult)>0 AND (series_id, a_cid, b_cid) NOT IN (SELECT (series_id, a_cid, b_cid) FROM ed)),
mx2 AS (SELECT sb.series_id, sb.cid AS external_id, CASE WHEN amb THEN 'ambiguous_match' WHEN ma.b_cid IS NOT NULL THEN 'direct_match' WHEN alx.b_cid IS NOT NULL THEN 'possible_alias' ELSE 'external_only' END AS status, CASE WHEN NOT amb THEN m END AS candidate_id, score FROM sb LEFT JOIN ma ON ma.series_id=sb.series_id AND ma.b_cid=sb.cid LEFT JOIN alx ON alx.series_id=sb.series_id AND alx.b_cid=sb.cid)"""


def external_matches(t):
    a, b = both(t)
    return idt.match_external(a, b, cleaning.quality_filter(t.obs()), 0.0, 30.0)


@query("jn08_ephemeris_match", MATCH + " SELECT series_id, external_id, status, candidate_id FROM mx2", "obs", PAIRS)
def _(t):
    return external_matches(t)


@query("id09_label_join", MATCH + """, lb AS (SELECT series_id, candidate_id, count(*) AS refs, count(DISTINCT CASE WHEN score>=100 THEN 'confirmed' WHEN score>=60 THEN 'fp' ELSE 'pc' END) AS kinds, min(CASE WHEN score>=100 THEN 'confirmed' WHEN score>=60 THEN 'fp' ELSE 'pc' END) AS k FROM mx2 WHERE candidate_id IS NOT NULL GROUP BY ALL)
 SELECT sa.series_id, sa.cid AS candidate_id, coalesce(refs,0) AS refs, CASE WHEN kinds>1 THEN NULL ELSE coalesce(k,'none') END AS disposition, CASE WHEN kinds>1 THEN 'label_held' WHEN kinds IS NULL THEN 'no_label' ELSE 'consistent_labels' END AS decision FROM sa LEFT JOIN lb ON lb.series_id=sa.series_id AND lb.candidate_id=sa.cid""", "obs", PAIRS)
def _(t):
    a, b = both(t)
    m = idt.match_external(a, b, cleaning.quality_filter(t.obs()), 0.0, 30.0).filter("candidate_id IS NOT NULL")
    label = F.when(F.col("score") >= 100, "confirmed").when(F.col("score") >= 60, "fp").otherwise("pc")
    lab = m.join(b.select("series_id", F.col("cid").alias("external_id"), label.alias("label")), ["series_id", "external_id"])
    per = lab.groupBy("series_id", "candidate_id").agg(F.count(F.lit(1)).alias("refs"), F.collect_set("label").alias("k"))
    x = a.select("series_id", F.col("cid").alias("candidate_id")).join(per, ["series_id", "candidate_id"], "left")
    n = F.size("k")
    return x.select("series_id", "candidate_id", F.coalesce("refs", F.lit(0)).alias("refs"), F.when(F.col("k").isNull(), "none").when(n == 1, F.col("k")[0]).alias("disposition"),
                    F.when(F.col("k").isNull(), "no_label").when(n > 1, "label_held").otherwise("consistent_labels").alias("decision"))


SEL = """sel0 AS (SELECT event_id AS id, user_id AS series_id, k, 2.0::DOUBLE+k%4 AS period, (k%8)/8.0::DOUBLE AS phase_start, (k%8)/8.0::DOUBLE+(1+k%5)/16.0::DOUBLE AS phase_end, CASE WHEN k%11=0 THEN NULL WHEN k%7=0 THEN 'MAYBE' ELSE 'LIKELY' END AS judgment FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events WHERE event_type='view')),
sel1 AS (SELECT *, phase_end-phase_start AS width, (phase_start+phase_end)/2-floor((phase_start+phase_end)/2) AS ctr FROM sel0),
kk AS (SELECT *, ceil((0.0-15.0)/period-ctr) AS klo, floor((30.0-15.0)/period-ctr) AS khi FROM sel1),
ep AS (SELECT id, unnest(range(CAST(klo AS BIGINT), CAST(khi AS BIGINT)+1)) AS kx, ctr, period FROM kk),
be AS (SELECT id, 15.0::DOUBLE+(ctr+kx)*period AS epoch FROM ep QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(15.0::DOUBLE+(ctr+kx)*period-15.0), 15.0::DOUBLE+(ctr+kx)*period)=1),
sel AS (SELECT kk.id, series_id, period, phase_start, phase_end, width, ctr, epoch, judgment FROM kk LEFT JOIN be USING (id))"""


def selections(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    x = t.events.filter("event_type = 'view'").withColumn("k", k).select(
        F.col("event_id").alias("id"), F.col("user_id").alias("series_id"), (F.lit(2.0) + F.col("k") % 4).alias("period"), ((F.col("k") % 8) / F.lit(8.0)).alias("phase_start"),
        ((F.col("k") % 8) / F.lit(8.0) + (1 + F.col("k") % 5) / F.lit(16.0)).alias("phase_end"), F.when(F.col("k") % 11 == 0, None).when(F.col("k") % 7 == 0, "MAYBE").otherwise("LIKELY").alias("judgment"))
    mid = (F.col("phase_start") + F.col("phase_end")) / 2
    x = x.withColumns({"width": F.col("phase_end") - F.col("phase_start"), "ctr": mid - F.floor(mid)})
    return x.withColumn("epoch", mt.derived_epoch(F.lit(15.0), F.col("period"), F.col("ctr"), F.lit(0.0), F.lit(30.0)))


@query("ts36_selection_epoch", "SELECT id, round(ctr,8) AS phase_centre, round(epoch,8) AS epoch FROM sel", ctes=SEL)
def _(t):
    return selections(t).select("id", F.round("ctr", 8).alias("phase_centre"), F.round("epoch", 8).alias("epoch"))


@query("id10_submission_validation", """SELECT id, CASE WHEN NOT (phase_start>=0 AND phase_start<1 AND phase_start<phase_end AND phase_end<phase_start+1) THEN 'phaseEnd:VALIDATION_FAILED' WHEN width*period<0.2 THEN 'phaseEnd:MIN_WINDOW' WHEN width>0.25 THEN 'phaseEnd:PHASE_WIDTH_MAX' WHEN epoch IS NULL THEN 'selection:EPOCH_OUT_OF_RANGE'
 WHEN judgment IS NULL OR judgment NOT IN ('LIKELY','UNLIKELY','UNSURE') THEN 'userJudgment:VALIDATION_FAILED' WHEN period<2.5 OR period>10 THEN 'periodDays:OUTSIDE_PERIOD_GRID' END AS rejection FROM sel""", ctes=SEL)
def _(t):
    return mt.validate(selections(t), min_window=0.2, width_max=0.25, period_min=2.5, period_max=10.0, judgments=("LIKELY", "UNLIKELY", "UNSURE")).select("id", "rejection")


EVAL = """, cc AS (SELECT c.*, c.epoch+n*c.period AS ctr_t FROM (SELECT *, unnest(range(CAST(floor((0-epoch)/period)-1 AS BIGINT), CAST(ceil((30-epoch)/period)+2 AS BIGINT))) AS n FROM sa) c), oc AS (SELECT * FROM cc WHERE EXISTS (SELECT 1 FROM run r WHERE r.series_id=cc.series_id AND greatest(ctr_t-cc.duration/2, r0)<=least(ctr_t+cc.duration/2, r1))),
ct AS (SELECT c.series_id, c.cid, any_value(c.period) AS cp, any_value(c.epoch) AS ce, any_value(c.duration) AS cd, count(o.ctr_t) AS observed FROM sa c LEFT JOIN oc o ON o.series_id=c.series_id AND o.cid=c.cid GROUP BY ALL),
ov AS (SELECT s.id, o.cid, count(*) AS overlap FROM (SELECT s.id, o.cid, o.series_id, greatest(ctr_t-o.duration/2, m-s.width*s.period/2) AS lo, least(ctr_t+o.duration/2, m+s.width*s.period/2) AS hi FROM (SELECT sel.*, oc.cid AS ocid, oc.ctr_t AS c2, sel.epoch+floor((oc.ctr_t-sel.epoch)/sel.period+0.5)*sel.period AS m FROM sel JOIN oc ON oc.series_id=sel.series_id) s JOIN oc o ON o.series_id=s.series_id AND o.cid=s.ocid AND o.ctr_t=s.c2) z
 JOIN sel s ON s.id=z.id JOIN sa o ON o.series_id=z.series_id AND o.cid=z.cid WHERE lo<=hi AND EXISTS (SELECT 1 FROM run r WHERE r.series_id=z.series_id AND greatest(lo, r0)<=least(hi, r1)) GROUP BY ALL),
ev0 AS (SELECT s.id, ct.cid AS candidate_id, m AS multiplier, observed, coalesce(overlap,0) AS overlap, s.width*s.period/cd AS ratio, abs(s.period*m-cp)*least(observed,6)/greatest(cd/2,0.05) AS e_period, (s.epoch-ce) AS off, least(s.period,cp) AS mo, greatest(cd/2,0.05) AS half FROM sel s JOIN ct ON ct.series_id=s.series_id CROSS JOIN (VALUES (0.5::DOUBLE),(1.0),(2.0)) z(m) LEFT JOIN ov ON ov.id=s.id AND ov.cid=ct.cid),
ev AS (SELECT *, least(abs(off-(floor(off/mo+0.5)-1)*mo), abs(off-floor(off/mo+0.5)*mo), abs(off-(floor(off/mo+0.5)+1)*mo))/half AS e_epoch, abs(log2(ratio)) AS e_duration FROM ev0),
es AS (SELECT *, greatest(e_period, e_epoch, e_duration) AS score, coalesce(overlap*1.0/nullif(observed,0),0) AS overlap_ratio, e_period<=1 AND e_epoch<=1 AND ratio BETWEEN 0.8 AND 1.6 AND overlap>=1 AS pass FROM ev)"""
MATCHED = BINNED + "," + EVENTS_OF + "," + side("sa", "purchase") + "," + SEL


def evaluations(t):
    sel = selections(t)
    cand = cut_lineage(signals(t, "purchase"))
    # Observed events are counted per candidate and met by the selections: written once.
    events = cut_lineage(mt.observed_events(cand, observed(t), 0.0, 30.0))
    # The readings feed the ranking twice and the hints once: written once.
    return sel, cut_lineage(mt.evaluate(sel, cand, events, [0.5, 1.0, 2.0], min_window=0.1, ratio_min=0.8, ratio_max=1.6, min_overlap=1, transits_cap=6))


@query("id11_submission_evaluations", EVAL + " SELECT id, candidate_id, multiplier, observed, overlap, round(e_period,6) AS e_period, round(e_epoch,6) AS e_epoch, round(e_duration,6) AS e_duration, pass FROM es", "obs", MATCHED)
def _(t):
    r = lambda c: F.round(c, 6).alias(c)
    return evaluations(t)[1].select("id", "candidate_id", "multiplier", F.col("observed").cast("bigint").alias("observed"), F.col("overlap").cast("bigint").alias("overlap"), r("e_period"), r("e_epoch"), r("e_duration"), "pass")


DECIDE = EVAL + """, bp AS (SELECT id, candidate_id, multiplier=1 AS direct, min(score) AS score, arg_min(overlap_ratio, score) AS orr, arg_min(multiplier, (score, multiplier)) AS mult FROM es WHERE pass GROUP BY ALL), dp AS (SELECT * FROM bp WHERE direct=(SELECT bool_or(direct) FROM bp b WHERE b.id=bp.id)), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score, candidate_id) AS rn, count(*) OVER (PARTITION BY id) AS np FROM dp),
dd AS (SELECT s.id, a.np, a.candidate_id, a.mult, abs(a.score-b.score)<=1e-9 OR b.score-a.score<0.05 OR a.score>0.9*b.score OR a.orr<b.orr-0.2 AS bad FROM sel s LEFT JOIN rk a ON a.id=s.id AND a.rn=1 LEFT JOIN rk b ON b.id=s.id AND b.rn=2),
stt AS (SELECT id, CASE WHEN np IS NULL THEN 'not_matched' WHEN np>1 AND bad THEN 'ambiguous_match' WHEN mult=1 THEN 'matched' ELSE 'matched_harmonic' END AS status, candidate_id, mult FROM dd)"""


@query("id12_match_decision", DECIDE + " SELECT id, status, CASE WHEN status LIKE 'matched%' THEN candidate_id END AS candidate_id, CASE WHEN status LIKE 'matched%' THEN mult END AS multiplier FROM stt", "obs", MATCHED)
def _(t):
    sel, ev = evaluations(t)
    return mt.decide(sel, ev, min_gap=0.05, dominance=0.9, overlap_tolerance=0.2)


@query("id12_miss_hints", DECIDE + ", h AS (SELECT id, arg_min(ratio, (score, candidate_id)) AS r FROM es WHERE multiplier=1 AND e_period<=1 AND e_epoch<=1 AND overlap>=1 AND NOT ratio BETWEEN 0.8 AND 1.6 GROUP BY 1) SELECT id, CASE WHEN r>1.6 THEN 'WINDOW_TOO_WIDE' ELSE 'WINDOW_TOO_NARROW' END AS hint FROM h JOIN stt USING (id) WHERE status='not_matched'", "obs", MATCHED)
def _(t):
    sel, ev = evaluations(t)
    return mt.miss_hints(mt.decide(sel, ev, min_gap=0.05, dominance=0.9, overlap_tolerance=0.2), ev, min_overlap=1, ratio_max=1.6)


GRIDQ = """inj AS (SELECT s.series_id, period, duration, depth, phase, tf+phase*period AS epoch FROM (SELECT series_id, min(t) AS tf FROM obs WHERE q=0 GROUP BY 1) s, (VALUES (2.0::DOUBLE),(3.5)) p(period), (VALUES (0.4::DOUBLE),(0.8)) d(duration), (VALUES (0.2::DOUBLE),(0.5)) h(depth), (VALUES (0.25::DOUBLE),(0.75)) f(phase))"""


def first_times(t):
    return cleaning.quality_filter(t.obs()).groupBy("series_id").agg(F.min("t").alias("t_first"))


@query("ts33_injection_catalogue", f", w AS (SELECT inj.series_id, inj.period, inj.duration, inj.depth, inj.phase, floor((t-epoch)/period+0.5) AS c FROM inj JOIN obs USING (series_id) WHERE q=0 AND abs({se.dist('t', 'period', 'epoch')})<duration/2), g AS (SELECT series_id, period, duration, depth, phase, count(DISTINCT c) AS n_transits, count(*) AS n_points FROM w GROUP BY ALL) SELECT series_id, period, duration, depth, phase, round(epoch,8) AS epoch, coalesce(n_transits,0) AS n_transits, coalesce(n_points,0) AS n_points FROM inj LEFT JOIN g USING (series_id, period, duration, depth, phase)", "obs", GRIDQ)
def _(t):
    grid = mt.injection_grid(first_times(t), [2.0, 3.5], [0.4, 0.8], [0.2, 0.5], [0.25, 0.75])
    return observed_grid(grid, t).select("series_id", "period", "duration", "depth", "phase", F.round("epoch", 8).alias("epoch"), "n_transits", "n_points")


def observed_grid(grid, t):
    """Counts by injection number; the number keys the grid point."""
    numbered = grid.withColumn("gid", F.concat_ws("|", "period", "duration", "depth", "phase"))
    return mt.observed_injections(numbered, cleaning.quality_filter(t.obs()), ["gid"])


ONE = """in1 AS (SELECT series_id, 3.0::DOUBLE+(series_id%3)*0.5::DOUBLE AS period, 0.8::DOUBLE AS duration, 0.7::DOUBLE AS depth, tf+0.25::DOUBLE*(3.0::DOUBLE+(series_id%3)*0.5::DOUBLE) AS epoch FROM (SELECT series_id, min(t) AS tf FROM pts0 GROUP BY 1))"""
INJ_PTS = se.PTS.split(",\nsig AS")[0].replace("pts AS (", "pts0 AS (", 1) + ",\n" + ONE + f",\npts AS (SELECT p.series_id, p.part_id, p.seq, p.t, p.y*CASE WHEN abs({se.dist('p.t', 'i.period', 'i.epoch')})<i.duration/2 THEN 1-i.depth ELSE 1 END AS y FROM pts0 p JOIN in1 i USING (series_id)),\nsig AS" + se.PTS.split(",\nsig AS")[1]
INJ_PG = INJ_PTS + se.PG[len(se.PTS):]


def injection(pts):
    p = F.lit(3.0) + (F.col("series_id") % 3) * F.lit(0.5)
    x = pts.groupBy("series_id").agg(F.min("t").alias("tf")).withColumns({"model_id": F.lit(1), "period": p, "duration": F.lit(0.8), "depth": F.lit(0.7)})
    return x.withColumn("epoch", F.col("tf") + F.lit(0.25) * F.col("period")).drop("tf")


def injected(t):
    pts = se.points(t)
    inj = injection(pts)
    return inj, mo.with_model(pts, inj).withColumn("y", F.col("y") * F.col("model")).drop("model")


@query("ts34_injection_apply", "SELECT series_id, seq, round(y,8) AS y FROM pts", "obs", INJ_PTS)
def _(t):
    return injected(t)[1].select("series_id", "seq", F.round("y", 8).alias("y"))


@query("ts35_recovery_metrics", f""", c AS (SELECT p.*, i.depth, abs({se.dist('p.t', 'i.period', 'i.epoch')})<i.duration/2 AS mine, y<3 AS kept FROM pts p JOIN in1 i USING (series_id)), g AS (SELECT series_id, any_value(depth) AS depth, count(*) FILTER (mine) AS n_in, count(*) FILTER (mine AND kept) AS n_kept, median(y) FILTER (NOT mine AND kept) AS o, median(y) FILTER (mine AND kept) AS i FROM c GROUP BY 1), s AS (SELECT c.series_id, 1.4826*median(abs(y-o)) AS sc FROM c JOIN g USING (series_id) WHERE NOT mine AND kept GROUP BY 1)
 SELECT series_id, n_in, round(n_kept*1.0/nullif(n_in,0),8) AS kept_ratio, round((o-i)/depth,7) AS depth_ratio, round(sc,7) AS out_scatter FROM g LEFT JOIN s USING (series_id)""", "obs", INJ_PTS)
def _(t):
    inj, pts = injected(t)
    x = pts.join(inj.drop("model_id"), "series_id").withColumns({"mine": in_window("t", F.col("period"), F.col("epoch"), F.col("duration")), "kept": F.col("y") < 3})
    counts = x.groupBy("series_id", "depth").agg(F.count_if("mine").alias("n_in"), F.count_if(F.col("mine") & F.col("kept")).alias("n_kept"))
    med = grouped_median(x.filter("kept"), ["series_id", "mine"], F.col("y"), "m").groupBy("series_id").pivot("mine", [True, False]).agg(F.first("m"))
    sc = grouped_mad(x.filter("kept AND NOT mine"), "series_id", F.col("y")).drop("med")
    x = counts.join(med, "series_id", "left").join(sc, "series_id", "left")
    return x.select("series_id", "n_in", F.round(F.try_divide("n_kept", "n_in"), 8).alias("kept_ratio"), F.round((F.col("false") - F.col("true")) / F.col("depth"), 7).alias("depth_ratio"), F.round("scatter", 7).alias("out_scatter"))


MI = ", " + se.greedy_sql("pg", 5, "abs(x.period/c.period-1)<0.02::DOUBLE") + f""", nt AS (SELECT i.series_id, count(DISTINCT floor((t-epoch)/period+0.5)) AS ntr FROM in1 i JOIN pts USING (series_id) WHERE abs({se.dist('t', 'period', 'epoch')})<duration/2 GROUP BY 1),
w AS (SELECT i.series_id, a.rank, count(*) FILTER (abs({se.dist('t', 'i.period', 'i.epoch')})<i.duration/2 AND abs({se.dist('t', 'a.period', 'a.epoch')})<a.duration/2) AS s, count(*) FILTER (abs({se.dist('t', 'i.period', 'i.epoch')})<i.duration/2) AS ai, count(*) FILTER (abs({se.dist('t', 'a.period', 'a.epoch')})<a.duration/2) AS bi FROM in1 i JOIN a5 a USING (series_id) JOIN pts ON pts.series_id=i.series_id GROUP BY ALL),
k AS (SELECT i.series_id, i.period, i.duration, a.rank, a.period AS pp, s*1.0/nullif(least(ai,bi),0) AS ovl, coalesce(ntr,0) AS ntr FROM in1 i JOIN a5 a USING (series_id) LEFT JOIN w USING (series_id, rank) LEFT JOIN nt ON nt.series_id=i.series_id),
kd AS (SELECT *, CASE WHEN ovl>=0.5 AND abs(pp/1.0-period)*greatest(ntr,1)/(duration/2)<=1 THEN 'direct' WHEN ovl>=0.5 AND abs(pp/0.5-period)*greatest(ntr,1)/(duration/2)<=1 THEN 'alias_half' WHEN ovl>=0.5 AND abs(pp/2.0-period)*greatest(ntr,1)/(duration/2)<=1 THEN 'alias_double' END AS kind FROM k),
mi AS (SELECT * FROM kd QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY CASE WHEN kind='direct' THEN 0 WHEN kind IS NOT NULL THEN 1 ELSE 2 END, CASE WHEN kind IS NOT NULL THEN rank ELSE abs(pp/period-1) END)=1)"""


def injection_matches(t):
    inj, pts = injected(t)
    pts = cut_lineage(pts)
    pg = bs.periodogram(pts, value="y", periods=se.GRID, durations=se.DURATIONS, oversample=se.OVERSAMPLE, cell_days=se.CELL)
    peaks = cut_lineage(se.top_peaks(pg))
    inj = observed_injections_one(inj, pts)
    return peaks, mt.match_injections(inj, peaks, pts), pts


def observed_injections_one(inj, pts):
    return mt.observed_injections(inj, pts, ["model_id"])


@query("id13_injection_match", MI + " SELECT series_id, coalesce(kind,'wrong') AS match, rank AS matched_rank, round(ovl,8) AS window_overlap, round(pp/period-1,8) AS period_rel_err FROM mi", "obs", INJ_PG)
def _(t):
    return injection_matches(t)[1].select("series_id", "match", "matched_rank", F.round("window_overlap", 8).alias("window_overlap"), F.round("period_rel_err", 8).alias("period_rel_err"))


@query("ag27_recovery_summary", MI + """ SELECT coalesce(band,'all') AS band, count(*) AS n_signals, round(count(*) FILTER (kind='direct')*1.0/count(*),8) AS direct_recovery, round(count(*) FILTER (kind IS NOT NULL)*1.0/count(*),8) AS alias_inclusive, round(count(*) FILTER (kind IS NULL)*1.0/count(*),8) AS wrong_rate, round(median(abs(pp/period-1)) FILTER (kind IS NOT NULL),8) AS median_period_error FROM (SELECT *, CASE WHEN period<3.4 THEN 'short' ELSE 'long' END AS band FROM mi) GROUP BY GROUPING SETS ((band), ())""", "obs", INJ_PG)
def _(t):
    band = F.when(F.col("period") < 3.4, "short").otherwise("long")
    m = injection_matches(t)[1].withColumn("band", F.explode(F.array(band, F.lit("all"))))
    m = cut_lineage(m.select("band", "match", F.abs("period_rel_err").alias("error"), F.col("match").isin("direct", "alias_half", "alias_double").alias("hit")))
    share = lambda cond: F.round(F.count_if(cond) / F.count(F.lit(1)), 8)
    rates = m.groupBy("band").agg(F.count(F.lit(1)).alias("n_signals"), share(F.col("match") == "direct").alias("direct_recovery"), share(F.col("hit")).alias("alias_inclusive"), share(~F.col("hit")).alias("wrong_rate"))
    errors = grouped_median(m.filter("hit"), ["band"], F.col("error"), "e").select("band", F.round("e", 8).alias("median_period_error"))
    return rates.join(errors, "band", "left")


@query("ag29_gate_grid", MI + f""", tn AS (SELECT a.series_id, a.rank, count(DISTINCT floor((t-epoch)/period+0.5)) AS ntr FROM a5 a JOIN pts ON pts.series_id=a.series_id AND abs({se.dist('pts.t', 'a.period', 'a.epoch')})<a.duration/2 GROUP BY ALL), z AS (SELECT a.series_id, a.rank, snr, sde, coalesce(tn.ntr,0) AS ntr, mi.series_id IS NOT NULL AS rec FROM a5 a LEFT JOIN tn USING (series_id, rank) LEFT JOIN mi ON mi.series_id=a.series_id AND mi.rank=a.rank AND mi.kind IS NOT NULL)
 SELECT x AS snr_min, y AS sde_min, w AS transits_min, count(*) FILTER (snr>=x AND sde>=y AND ntr>=w) AS survivors, count(*) FILTER (snr>=x AND sde>=y AND ntr>=w AND rec) AS recovered FROM z, (VALUES (2.0::DOUBLE),(3.0),(4.0)) p(x), (VALUES (1.0::DOUBLE),(2.0)) q(y), (VALUES (2.0::DOUBLE),(3.0)) r(w) GROUP BY ALL""", "obs", INJ_PG)
def _(t):
    peaks, m, pts = injection_matches(t)
    hit = m.filter("match IN ('direct','alias_half','alias_double')").select("series_id", F.col("matched_rank").alias("rank"), F.lit(True).alias("rec"))
    x = se.diagnosed(pts, peaks).join(hit, ["series_id", "rank"], "left").withColumn("recovered", F.coalesce("rec", F.lit(False)))
    return mt.gate_grid(x, [2.0, 3.0, 4.0], [1.0, 2.0], [2, 3])


@query("ts45_method_comparison")
def _(t):
    """Surviving and recovered peaks under each standardisation of the same periodogram."""
    inj, pts = injected(t)
    pts = cut_lineage(pts)
    pg = cut_lineage(bs.periodogram(pts, value="y", periods=se.GRID, durations=se.DURATIONS, oversample=se.OVERSAMPLE, cell_days=se.CELL))
    peaks = se.top_peaks(pg)
    m = mt.match_injections(observed_injections_one(inj, pts), peaks, pts).filter("match IN ('direct','alias_half','alias_double')").select("series_id", F.col("matched_rank").alias("rank"), F.lit(True).alias("rec"))
    ways = (pg.select("series_id", "idx", "sde", F.lit("global").alias("method")).unionByName(bs.running_median_sde(pg, size=21).select("series_id", "idx", "sde", F.lit("running_median").alias("method")))
            .unionByName(bs.log_bin_sde(pg, bins=6, lo=1.5, hi=9.5, min_size=8).select("series_id", "idx", "sde", F.lit("log_bin").alias("method"))))
    x = peaks.drop("sde").join(ways, ["series_id", "idx"]).join(m, ["series_id", "rank"], "left").withColumn("sde_min", F.explode(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))
    return x.groupBy("method", "sde_min").agg(F.count_if(F.col("sde") >= F.col("sde_min")).alias("survivors"), F.count_if((F.col("sde") >= F.col("sde_min")) & F.col("rec")).alias("recovered"))


@query("ag43_rule_set_sweep", """, st(name, ms) AS (VALUES ('unity',[1.0::DOUBLE]),('octave',[0.5::DOUBLE,1.0,2.0]),('wide',[0.25::DOUBLE,0.5,1.0,2.0,4.0])), d AS (SELECT name, pp.*, len(list_filter(ms, lambda m: abs(bp-m*ap)*3<=greatest(ad,bd)/2))>0 AS blocked FROM pp, st)
 SELECT name, count(*) AS pairs, count(*) FILTER (blocked) AS blocked_pairs, count(*) FILTER (blocked AND dist<=0.5) AS blocked_direct FROM d GROUP BY 1""", ctes=PAIRS)
def _(t):
    from phasemill.operators.iterate import harmonic_duplicate
    sets = {"unity": (1.0,), "octave": (0.5, 1.0, 2.0), "wide": (0.25, 0.5, 1.0, 2.0, 4.0)}
    # The index gives the pairs that any set blocks; one pass counts for all sets. The total comes from counts per series.
    a, b = both(t)
    counts = []
    for name, ms in sets.items():
        hit = harmonic_duplicate("b_period", "b_duration", F.lit(3), "a_period", "a_duration", ms)
        counts += [F.count_if(hit).alias(f"{name}_pairs"), F.count_if(hit & F.col("direct")).alias(f"{name}_direct")]
    sizes = a.groupBy("series_id").agg(F.count(F.lit(1)).alias("na")).join(b.groupBy("series_id").agg(F.count(F.lit(1)).alias("nb")), "series_id")
    total = sizes.agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("pairs"))
    near = idt.harmonic_pairs(a, b, sorted({m for ms in sets.values() for m in ms}), 3, 0.0, 30.0, 0.5)
    row = near.agg(*counts).join(total)  # one row each
    rows = [F.struct(F.lit(name).alias("name"), "pairs", F.col(f"{name}_pairs").alias("blocked_pairs"), F.col(f"{name}_direct").alias("blocked_direct")) for name in sets]
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query("id18_tolerance_sweep", "SELECT tol, count(*) FILTER (dist<=tol) AS edges, count(DISTINCT CASE WHEN dist<=tol THEN a_cid END) AS matched_old, count(DISTINCT CASE WHEN dist<=tol THEN b_cid END) AS matched_new FROM pp, (VALUES (0.1::DOUBLE),(0.25),(0.5),(1.0)) z(tol) GROUP BY tol", ctes=PAIRS)
def _(t):
    tols = F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 1.0)])
    # The index takes the widest tolerance; an edge of a narrower one is among its pairs.
    x = idt.near_pairs(*both(t), 0.0, 30.0, 1.0).withColumn("tol", F.explode(tols))
    hit = F.col("dist") <= F.col("tol")
    return x.groupBy("tol").agg(F.count_if(hit).alias("edges"), F.count_distinct(F.when(hit, F.col("a_cid"))).alias("matched_old"), F.count_distinct(F.when(hit, F.col("b_cid"))).alias("matched_new"))


@query("id19_best_reference", "SELECT series_id, b_cid, arg_min(a_cid, (e, a_cid)) AS reference, round(min(e),8) AS rel_err FROM (SELECT *, least(abs(bp/ap-1), abs(bp/(2*ap)-1), abs(bp/(0.5*ap)-1)) AS e FROM pp) WHERE e<=0.3 GROUP BY ALL", ctes=PAIRS)
def _(t):
    a, b = both(t)
    slots = [(0.7 * m * F.col("a_period"), 1.3 * m * F.col("a_period")) for m in (1.0, 2.0, 0.5)]
    p = idt.probe_join(a.select("series_id", F.col("cid").alias("a_cid"), F.col("period").alias("a_period")),
                       b.select("series_id", F.col("cid").alias("b_cid"), F.col("period").alias("b_period")), slots, cell=0.1)
    err = F.least(*[F.abs(F.col("b_period") / (m * F.col("a_period")) - 1) for m in (1.0, 2.0, 0.5)])
    x = p.withColumn("e", err).filter("e <= 0.3")
    return x.groupBy("series_id", "b_cid").agg(F.min_by("a_cid", F.struct("e", "a_cid")).alias("reference"), F.round(F.min("e"), 8).alias("rel_err"))


REV = "o AS (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag='R') AS was FROM lineitem WHERE l_linestatus='F' GROUP BY ALL), n AS (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag='R') AS now FROM lineitem WHERE l_linestatus='O' GROUP BY ALL)"


def revisions(t):
    g = lambda s, name: t.lineitem.filter(F.col("l_linestatus") == s).groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(F.col("l_returnflag") == "R").alias(name))
    return g("F", "was"), g("O", "now")


@query("id14_revision_changes", "SELECT l_orderkey, l_linenumber FROM o JOIN n USING (l_orderkey, l_linenumber) WHERE NOT was AND now", ctes=REV)
def _(t):
    o, n = revisions(t)
    return o.join(n, ["l_orderkey", "l_linenumber"]).filter("NOT was AND now").select("l_orderkey", "l_linenumber")


@query("id15_snapshot_proposal", "SELECT l_orderkey, l_linenumber, CASE WHEN now IS NULL THEN 'retain' WHEN was=now THEN 'unchanged' ELSE 'review' END AS proposal FROM o LEFT JOIN n USING (l_orderkey, l_linenumber)", ctes=REV)
def _(t):
    o, n = revisions(t)
    p = F.when(F.col("now").isNull(), "retain").when(F.col("was") == F.col("now"), "unchanged").otherwise("review")
    return o.join(n, ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", p.alias("proposal"))


@query("id16_score_verdict_ledger", """, a AS (SELECT id, candidate_id, created_at, value/500 AS score, first_value(id) OVER (PARTITION BY candidate_id, user_id ORDER BY created_at, id) AS src, row_number() OVER (PARTITION BY candidate_id ORDER BY created_at DESC, id DESC)=1 AS current FROM sub)
 SELECT a.id, a.candidate_id, CASE WHEN a.src=a.id THEN 'inference' ELSE 'reuse_score' END AS mode, CASE WHEN s.score<0.05 THEN 'rejected' WHEN s.score>=0.15 THEN 'approved' ELSE 'hold' END AS verdict, a.current FROM a JOIN (SELECT id, value/500 AS score FROM sub) s ON s.id=a.src""", "sub", D)
def _(t):
    s = t.submissions().withColumn("score", F.col("value") / 500)
    first = latest(s, ["candidate_id", "user_id"], ["created_at", "id"], first=True, keep=["candidate_id", "user_id", "id", "score", "created_at"]).select("candidate_id", "user_id", F.col("id").alias("src"), F.col("score").alias("used"))
    now = s.groupBy("candidate_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("cur"))
    x = s.join(first, ["candidate_id", "user_id"]).join(now, "candidate_id")
    verdict = F.when(F.col("used") < 0.05, "rejected").when(F.col("used") >= 0.15, "approved").otherwise("hold")
    return x.select("id", "candidate_id", F.when(F.col("src") == F.col("id"), "inference").otherwise("reuse_score").alias("mode"), verdict.alias("verdict"), (F.col("id") == F.col("cur")).alias("current"))


BLOCKS = f""", m AS (SELECT series_id, y, CAST(floor((t-0.5)/4.0::DOUBLE+0.25) AS BIGINT) AS blk, abs({se.dist('t', '2.0::DOUBLE', '0.5::DOUBLE')})<1.0::DOUBLE/2 AS ms, abs({se.dist('t', '4.0::DOUBLE', '0.5::DOUBLE')})<1.0::DOUBLE/2 AS ml FROM pts),
 b AS (SELECT series_id, blk, count(*) FILTER (ms AND NOT ml) AS nx, count(*) FILTER (ml) AS ny, count(*) FILTER (NOT ms AND NOT ml) AS no, avg(y) FILTER (ms AND NOT ml)-avg(y) FILTER (ml) AS diff, sqrt(var_samp(y) FILTER (ms AND NOT ml)/count(*) FILTER (ms AND NOT ml)+var_samp(y) FILTER (ml)/count(*) FILTER (ml)) AS err,
  avg(y) FILTER (NOT ms AND NOT ml)-(avg(y) FILTER (ms AND NOT ml)+avg(y) FILTER (ml))/2 AS depth FROM m GROUP BY ALL),
 bd AS (SELECT series_id, CAST(ceil((min(t)+0.5-0.5)/4.0::DOUBLE) AS BIGINT) AS f0, CAST(floor((max(t)-0.5-2.0-0.5)/4.0::DOUBLE) AS BIGINT) AS l0 FROM pts GROUP BY 1),
 pb AS (SELECT bd.series_id, greatest(any_value(l0)-any_value(f0)+1,0) AS expected_blocks, count(blk) AS paired_blocks, avg(diff) AS mean_diff, max(abs(diff)) AS max_diff, min(depth) AS min_depth, greatest(max(err), stddev_samp(diff)/sqrt(count(blk))) AS error
  FROM bd LEFT JOIN b ON b.series_id=bd.series_id AND blk BETWEEN f0 AND l0 AND nx>=2 AND ny>=2 AND no>=2 GROUP BY 1)"""


def blocks(t):
    return paired_blocks(se.points(t), short=(2.0, 0.5, 1.0), long=(4.0, 0.5, 1.0), value="y", min_points=2, min_blocks=3, margin=5.0)


@query("ts31_paired_block_equivalence", BLOCKS + " SELECT series_id, expected_blocks, paired_blocks, round(mean_diff,6) AS mean_diff, round(error,6) AS error FROM pb", "obs", se.PTS)
def _(t):
    return blocks(t).select("series_id", "expected_blocks", "paired_blocks", F.round("mean_diff", 6).alias("mean_diff"), F.round("error", 6).alias("error"))


# SQL has no t quantile: the table of its values covers any span of the inputs.
@query("ts31_equivalence_verdict", BLOCKS + ", cr(n, c) AS (VALUES " + ",".join(f"({n}, {critical(n)!r}::DOUBLE)" for n in range(2, 40)) + """)
 SELECT series_id, expected_blocks, paired_blocks, CASE WHEN paired_blocks<expected_blocks THEN 'missing_distinguishing_windows' WHEN expected_blocks<3 THEN 'insufficient_paired_blocks' WHEN error<=2.220446049250313e-16::DOUBLE THEN 'noise_not_measurable' WHEN min_depth<=c*error THEN 'primary_depth_not_supported'
  WHEN max_diff+c*error<5 THEN 'equivalent_within_margin' WHEN abs(mean_diff)-c*error>5 THEN 'distinct_depth_pattern' ELSE 'uncertainty_exceeds_margin' END AS verdict FROM pb LEFT JOIN cr ON n=expected_blocks""", "obs", se.PTS)
def _(t):
    return blocks(t).select("series_id", "expected_blocks", "paired_blocks", "verdict")


# The search of the discoverability rules: equal steps in log period, both neighbours of a maximum below it.
PG_LOG = se.PG.replace("1.5::DOUBLE+(9.5::DOUBLE-1.5::DOUBLE)*i/79 AS p", "1.5::DOUBLE*pow(9.5::DOUBLE/1.5::DOUBLE, i/79.0::DOUBLE) AS p")
STRICT = ", mx AS MATERIALIZED (SELECT * FROM (SELECT *, lag(power) OVER w AS pl, lead(power) OVER w AS pr FROM pg WINDOW w AS (PARTITION BY series_id ORDER BY idx)) WHERE power>pl AND power>pr)"
DISC = f""", sg0 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY series_id ORDER BY t, seq) >= 0.5 THEN 1 ELSE 0 END AS o FROM pts), sg1 AS (SELECT *, sum(o) OVER (PARTITION BY series_id ORDER BY t, seq) AS sg FROM sg0), sg2 AS (SELECT *, min(t) OVER (PARTITION BY series_id, sg) AS s0, max(t) OVER (PARTITION BY series_id, sg) AS s1 FROM sg1), ins AS (SELECT series_id, t FROM sg2 WHERE t-s0>=0.5 AND s1-t>=0.5),
pk AS (SELECT * FROM mx WHERE snr>=2 AND sde>=1.5), cy AS (SELECT pk.series_id, pk.idx, any_value(duration) AS d, count(*) AS k FROM pk JOIN ins ON ins.series_id=pk.series_id AND abs({se.dist('ins.t', 'pk.period', 'pk.epoch')})<pk.duration/2 GROUP BY pk.series_id, pk.idx, round_even((ins.t-pk.epoch)/pk.period,0)),
gd AS (SELECT series_id, idx FROM cy WHERE k>=0.5*d/0.25 GROUP BY ALL HAVING count(*)>=2), gp AS (SELECT pk.* FROM pk JOIN gd USING (series_id, idx)), ct AS (SELECT series_id, count(*) AS np, bool_or(sigma>0) AS scattered FROM pts LEFT JOIN sig USING (series_id) GROUP BY 1),
dn AS (SELECT md.series_id, md.model_id, any_value(md.period) AS mp, count(gp.idx) AS k, count(*) FILTER (abs(ln(gp.period/md.period))/(ln(9.5::DOUBLE/1.5::DOUBLE)/79)<=3 AND abs({se.dist('gp.epoch', 'md.period', 'md.epoch')})<=greatest(gp.duration,md.duration)/2) AS h FROM md LEFT JOIN gp ON gp.series_id=md.series_id GROUP BY ALL),
du AS (SELECT dn.*, CASE WHEN coalesce(np,0)<55 THEN 'input_insufficient' WHEN NOT coalesce(scattered,false) THEN 'calculation_failed' ELSE 'measured' END AS status FROM dn LEFT JOIN ct USING (series_id)),
ds AS (SELECT series_id, model_id, status, CASE WHEN status='measured' THEN k END AS n_peaks, CASE WHEN status='measured' THEN h END AS n_matched, CASE WHEN status='measured' THEN mp BETWEEN 1.5 AND 9.5 AND h>0 END AS discoverable,
 CASE WHEN status='input_insufficient' THEN 'insufficient_observations' WHEN status<>'measured' THEN 'degenerate_flux' WHEN NOT mp BETWEEN 1.5 AND 9.5 THEN 'outside_provided_grid' WHEN h>0 THEN 'matched_peak' ELSE 'no_matching_quality_peak' END AS reason FROM du)"""
RULES = dict(value="y", grid=se.GRID, snr_min=2.0, sde_min=1.5, min_points=55)


def log_search(pts):
    return bs.periodogram(pts, value="y", periods=se.GRID, durations=se.DURATIONS, oversample=se.OVERSAMPLE, cell_days=se.CELL, spacing="log")


@query("ts38_discoverability", STRICT + DISC + " SELECT * FROM ds", "obs", PG_LOG + ", " + se.MD)
def _(t):
    pts = se.points(t)
    return discoverable(pts, log_search(pts), se.models(t), **RULES)


def second_step(sql):
    """The same SQL over the points that the first model leaves: every table of the search has a second name."""
    names = "pts sig cel tot per pb occ wd win dep bst pg0 pg mx sg0 sg1 sg2 ins pk cy gd gp ct dn du ds"
    return re.sub(r"\b(" + "|".join(names.split()) + r")\b", r"\1_2", sql)


LEFT = f", pts_2 AS (SELECT p.series_id, p.part_id, p.seq, p.t, p.y/CASE WHEN abs({se.dist('p.t', 'm.period', 'm.epoch')})<m.duration/2 THEN 1-m.depth ELSE 1.0::DOUBLE END AS y FROM pts p JOIN md m ON m.series_id=p.series_id AND m.model_id=1),\n"


@query("ts39_candidate_discoverability", STRICT + DISC + LEFT + second_step(PG_LOG[PG_LOG.index("sig AS"):] + STRICT + DISC) + """, rn AS (SELECT * FROM ds WHERE model_id=1 UNION ALL SELECT * FROM ds_2 WHERE model_id=2)
SELECT *, CASE WHEN bool_or(status<>'measured') OVER (PARTITION BY series_id) THEN 'held' WHEN discoverable THEN 'discoverable' ELSE 'not_discoverable' END AS decision FROM rn""", "obs", PG_LOG + ", " + se.MD)
def _(t):
    return prefix_run(se.points(t), se.models(t), log_search, steps=2, **RULES)


@query("ts40_synthetic_noise")
def _(t):
    return noise_series(se.points(t), value="y", seed=7)


@query("ts43_negatives")
def _(t):
    """Strongest peak of synthetic noise and of the series after its models are removed."""
    pts = se.points(t)
    noise = cut_lineage(noise_series(pts, value="y", seed=11))
    res = mo.remove_models(pts, se.models(t), value="y").select("series_id", "part_id", "seq", "t", F.col("residual").alias("y"))
    best = lambda x, kind: se.top_peaks(se.pgram_of(x), 1).select("series_id", F.lit(kind).alias("kind"), "period", "power", "snr")
    return best(noise, "noise").unionByName(best(cut_lineage(res), "residual"))
