"""Aggregations: KPI, cohorts, votes, campaigns, evaluation."""

from pyspark.sql import functions as F

from phasemill.functions.hashing import record_set_digest
from phasemill.functions.scalars import json_strings, local_date
from phasemill.operators import statistics as st
from phasemill.operators.medians import grouped_median
from phasemill.operators.ordered import latest, numbered
from phasemill.operators.sizing import small
from phasemill.plans.registry import query, set_digest_sql
from phasemill.plans.relational import LATEST, latest_matches
from phasemill.plans.scalars import evidence
from phasemill.session import cut_lineage

D = "dummy AS (SELECT 1)"


def n(name="n"):
    return F.count(F.lit(1)).alias(name)


def nif(cond, name):
    return F.count_if(F.expr(cond) if isinstance(cond, str) else cond).alias(name)


@query("ag01_children_as_structs", """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS ordinal, count(*) OVER (PARTITION BY l_orderkey) AS n_lines, l_linenumber || ':' || l_partkey AS line FROM lineitem""")
def _(t):
    # A parent may hold any number of children: they stay rows with their place, not one list.
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    x = numbered(rows, "l_orderkey", ["l_linenumber", "l_partkey"], F.floor(F.col("l_linenumber") / 1000), "ordinal")
    x = x.join(rows.groupBy("l_orderkey").agg(n("n_lines")), "l_orderkey")
    return x.select("l_orderkey", "ordinal", "n_lines", F.concat_ws(":", "l_linenumber", "l_partkey").alias("line"))


@query("ag02_status_tally", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(n())


@query("ag03_distinct_pairs", "SELECT match_result, count(DISTINCT (user_id, star_id)) AS pairs, count(DISTINCT user_id) AS users FROM sub GROUP BY 1", "sub")
def _(t):
    # Distinct pairs are counted in two steps, so no single task holds a status's pairs.
    p = t.submissions().groupBy("match_result", "user_id", "star_id").agg(n())
    return p.groupBy("match_result", "user_id").agg(n("stars")).groupBy("match_result").agg(F.sum("stars").alias("pairs"), n("users"))


@query("ag04_filtered_aggregates", "SELECT star_id, count(*) AS n, count(*) FILTER (judgment='LIKELY') AS likely, count(*) FILTER (judgment='UNLIKELY') AS unlikely, round(avg(value) FILTER (match_result='matched'),8) AS matched_avg FROM sub GROUP BY 1", "sub")
def _(t):
    return t.submissions().groupBy("star_id").agg(n(), nif("judgment = 'LIKELY'", "likely"), nif("judgment = 'UNLIKELY'", "unlikely"),
                                                  F.round(F.avg(F.when(F.col("match_result") == "matched", F.col("value"))), 8).alias("matched_avg"))


@query("ag05_ratio_metric", "SELECT user_id, num, den, round(num*100.0/nullif(den,0),6) AS value, CASE WHEN den=0 THEN 'NO_SAMPLE' ELSE 'AVAILABLE' END AS status FROM (SELECT user_id, count(*) FILTER (match_result='matched' AND value>100) AS num, count(*) FILTER (value>100) AS den FROM sub GROUP BY 1)", "sub")
def _(t):
    x = t.submissions().groupBy("user_id").agg(nif("match_result = 'matched' AND value > 100", "num"), nif("value > 100", "den"))
    return x.select("user_id", "num", "den", *st.ratio("num", "den"))


KPI_SQL = """, act AS (SELECT sub.* FROM sub JOIN mem USING (user_id) WHERE status='active'), fm AS (SELECT *, row_number() OVER (PARTITION BY user_id, candidate_id ORDER BY created_at, id) AS rn FROM act WHERE match_result IN ('matched','matched_harmonic')),
g AS (SELECT fm.user_id, fm.candidate_id, coalesce((truth='planet' AND judgment='LIKELY') OR (truth='not_planet' AND judgment='UNLIKELY'),false) AS agrees FROM fm JOIN disp USING (candidate_id) WHERE rn=1 AND answer_class='graded'),
v AS (SELECT *, row_number() OVER (PARTITION BY user_id, candidate_id ORDER BY created_at DESC, id DESC) AS rn FROM act)"""


@query("ag06_kpi_table", KPI_SQL + """ SELECT 'submissions' AS key, count(*) AS value FROM act UNION ALL SELECT 'startedStars', count(DISTINCT (user_id, star_id)) FROM act UNION ALL SELECT 'uniqueStars', count(DISTINCT star_id) FROM act
 UNION ALL SELECT 'recognizedSignals', count(*) FROM fm WHERE rn=1 UNION ALL SELECT 'uniqueRecognizedSignals', count(DISTINCT candidate_id) FROM fm UNION ALL SELECT 'gradedFirstMatches', count(*) FROM g UNION ALL SELECT 'agreedFirstMatches', count(*) FROM g WHERE agrees
 UNION ALL SELECT 'publicLikely', count(*) FROM v WHERE rn=1 AND judgment='LIKELY' UNION ALL SELECT 'publicUnlikely', count(*) FROM v WHERE rn=1 AND judgment='UNLIKELY' UNION ALL SELECT 'publicUnsure', count(*) FROM v WHERE rn=1 AND judgment='UNSURE' UNION ALL SELECT 'publicParticipations', count(*) FROM v WHERE rn=1""", "sub mem disp", D)
def _(t):
    active = t.members().filter("status = 'active'").select("user_id")
    # One row per (member, signal, star) feeds every KPI; no KPI scans the submissions again.
    rank = F.struct("created_at", "id")
    hit = F.col("match_result").isin(*st.MATCHES)
    per = (t.submissions().join(active, "user_id", "left_semi").groupBy("user_id", "candidate_id", "star_id")
           .agg(n("subs"), F.min_by("judgment", F.when(hit, rank)).alias("first_judgment"), F.max_by("judgment", rank).alias("vote"))
           .withColumn("recognized", F.col("first_judgment").isNotNull()))
    per = per.join(t.dispositions(), "candidate_id", "left").withColumn("judgment", F.col("first_judgment"))
    per = per.withColumn("graded", F.col("recognized") & (F.coalesce("answer_class", F.lit("")) == "graded")).withColumn("agreed", F.col("graded") & st.agrees())
    stars = per.groupBy("star_id", "user_id").agg(n()).groupBy("star_id").agg(n("users"))
    sig = per.filter("recognized").groupBy("candidate_id").agg(n())
    head = per.agg(F.sum("subs").alias("submissions"), nif("recognized", "recognizedSignals"), nif("graded", "gradedFirstMatches"), nif("agreed", "agreedFirstMatches"),
                   nif("vote = 'LIKELY'", "publicLikely"), nif("vote = 'UNLIKELY'", "publicUnlikely"), nif("vote = 'UNSURE'", "publicUnsure"), n("publicParticipations"))
    names = head.columns
    out = head.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in names])).alias("r")).select("r.*")
    a = stars.agg(F.sum("users").alias("value")).select(F.lit("startedStars").alias("key"), "value")
    return out.unionByName(a).unionByName(st.kpis([("uniqueStars", stars), ("uniqueRecognizedSignals", sig)]))


STAGES = """, c AS (SELECT s_suppkey AS candidate_id, CAST(floor(s_suppkey/5) AS BIGINT) AS star_id, s_acctbal>1000 AS discoverable FROM supplier), m AS (SELECT DISTINCT user_id, candidate_id FROM sub WHERE match_result IN ('matched','matched_harmonic')),
       us AS (SELECT DISTINCT user_id, star_id FROM sub), a AS (SELECT us.user_id, us.star_id, count(*) AS active, count(*) FILTER (discoverable AND m.candidate_id IS NULL) AS open, count(*) FILTER (NOT discoverable AND m.candidate_id IS NULL) AS hidden FROM us JOIN c USING (star_id) LEFT JOIN m ON m.user_id=us.user_id AND m.candidate_id=c.candidate_id GROUP BY ALL),
       stg AS (SELECT *, CASE WHEN open>0 THEN 'analysis' WHEN hidden>0 THEN 'completed_with_hidden' ELSE 'completed' END AS stage FROM a)"""

# A star is unlocked by viewing it; a vote is public while the post that carries it is visible.
REPORT = KPI_SQL.replace("v AS (SELECT *, row_number()", "v0 AS (SELECT act.* FROM act JOIN posts ON post_id=id WHERE posts.status='visible'), v1 AS (SELECT *, row_number()").replace("FROM act)", "FROM v0)") + STAGES + """,
pv AS (SELECT * FROM v1 WHERE rn=1), un AS (SELECT DISTINCT user_id, star_id FROM act WHERE match_result='ambiguous_match'), ach AS (SELECT fm.user_id, fm.candidate_id, disposition, CASE disposition WHEN 'confirmed' THEN 'confirmed' WHEN 'fp' THEN 'fp' ELSE 'unconfirmed' END AS kind FROM fm LEFT JOIN disp USING (candidate_id) WHERE rn=1),
pr AS (SELECT stg.* FROM stg JOIN mem USING (user_id) WHERE status='active' AND stage='completed'),
counts(key, unit, numerator, denominator) AS (SELECT 'discoveredStars', 'STAR', count(*), NULL::BIGINT FROM un UNION ALL SELECT 'uniqueDiscoveredStars', 'STAR', count(DISTINCT star_id), NULL FROM un UNION ALL SELECT 'startedStars', 'STAR', count(DISTINCT (user_id, star_id)), NULL FROM act
 UNION ALL SELECT 'currentCompletedStars', 'STAR', count(*), NULL FROM pr UNION ALL SELECT 'uniqueCurrentCompletedStars', 'STAR', count(DISTINCT star_id), NULL FROM pr UNION ALL SELECT 'recognizedSignals', 'ACHIEVEMENT', count(*), NULL FROM ach
 UNION ALL SELECT kind || 'Achievements', 'ACHIEVEMENT', count(ach.kind), NULL FROM (VALUES ('confirmed'), ('unconfirmed'), ('fp')) k(kind) LEFT JOIN ach USING (kind) GROUP BY kind UNION ALL SELECT 'uniqueRecognizedSignals', 'SIGNAL', count(DISTINCT candidate_id), NULL FROM ach
 UNION ALL SELECT 'uniqueConfirmedSignals', 'SIGNAL', count(DISTINCT candidate_id) FILTER (disposition='confirmed'), NULL FROM ach UNION ALL SELECT 'uniqueFpSignals', 'SIGNAL', count(DISTINCT candidate_id) FILTER (disposition='fp'), NULL FROM ach
 UNION ALL SELECT 'uniqueUnconfirmedSignals', 'SIGNAL', count(DISTINCT candidate_id) FILTER (disposition IN ('pc','none')), NULL FROM ach UNION ALL SELECT 'firstMatchAccuracy', 'PERCENT', count(*) FILTER (agrees), count(*) FROM g
 UNION ALL SELECT 'publicLikelyPlanet', 'PARTICIPATION', count(*) FILTER (judgment='LIKELY'), NULL FROM pv UNION ALL SELECT 'publicUnlikelyPlanet', 'PARTICIPATION', count(*) FILTER (judgment='UNLIKELY'), NULL FROM pv UNION ALL SELECT 'publicUnsure', 'PARTICIPATION', count(*) FILTER (judgment='UNSURE'), NULL FROM pv
 UNION ALL SELECT 'publicLikelyPlanetRate', 'PERCENT', count(*) FILTER (judgment='LIKELY'), count(*) FROM pv UNION ALL SELECT 'publicUnlikelyPlanetRate', 'PERCENT', count(*) FILTER (judgment='UNLIKELY'), count(*) FROM pv UNION ALL SELECT 'publicUnsureRate', 'PERCENT', count(*) FILTER (judgment='UNSURE'), count(*) FROM pv
 UNION ALL SELECT 'publicParticipations', 'PARTICIPATION', count(*), NULL FROM pv UNION ALL SELECT 'aiAttemptUnknown', 'PARTICIPATION', count(*), NULL FROM pv),
kv AS (SELECT *, round(CASE WHEN denominator IS NULL THEN numerator::DOUBLE ELSE numerator*100.0::DOUBLE/nullif(denominator,0) END, 6) AS value, CASE WHEN denominator=0 THEN 'NO_SAMPLE' ELSE 'AVAILABLE' END AS status, CASE WHEN key='aiAttemptUnknown' THEN 'AI_ATTEMPT_UNKNOWN' WHEN denominator=0 THEN 'ZERO_DENOMINATOR' END AS reason FROM counts)"""


def kpi_report(t):
    active = t.members().filter("status = 'active'").select("user_id")
    rank = F.struct("created_at", "id")
    posts = t.posts().filter("status = 'visible'").select(F.col("post_id").alias("id"), F.lit(True).alias("public")).distinct()
    subs = t.submissions().join(active, "user_id", "left_semi").join(posts, "id", "left")
    # One row per (member, signal) feeds every KPI but progress; it is read for votes, signals and stars.
    per = subs.groupBy("user_id", "candidate_id", "star_id").agg(
        F.min_by("judgment", F.when(F.col("match_result").isin(*st.MATCHES), rank)).alias("judgment"), F.max_by("judgment", F.when(F.col("public"), rank)).alias("vote"),
        F.bool_or(F.col("match_result") == "ambiguous_match").alias("viewed")).join(t.dispositions(), "candidate_id", "left")
    per = cut_lineage(per.withColumn("recognized", F.col("judgment").isNotNull()))
    one = F.lit(1)
    hit = lambda cond: F.count_if(F.expr(cond) if isinstance(cond, str) else cond)
    graded = F.col("recognized") & (F.coalesce("answer_class", F.lit("")) == "graded")
    rest = "NOT coalesce(disposition, '') IN ('confirmed', 'fp')"
    heads = [("recognizedSignals", "ACHIEVEMENT", hit("recognized"), None), ("confirmedAchievements", "ACHIEVEMENT", hit("recognized AND disposition = 'confirmed'"), None),
             ("fpAchievements", "ACHIEVEMENT", hit("recognized AND disposition = 'fp'"), None), ("unconfirmedAchievements", "ACHIEVEMENT", hit("recognized AND " + rest), None),
             ("firstMatchAccuracy", "PERCENT", hit(graded & st.agrees()), hit(graded))]
    for key, vote in (("publicLikelyPlanet", "LIKELY"), ("publicUnlikelyPlanet", "UNLIKELY"), ("publicUnsure", "UNSURE")):
        heads += [(key, "PARTICIPATION", hit(f"vote = '{vote}'"), None), (key + "Rate", "PERCENT", hit(f"vote = '{vote}'"), F.count("vote"))]
    heads += [("publicParticipations", "PARTICIPATION", F.count("vote"), None), ("aiAttemptUnknown", "PARTICIPATION", F.count("vote"), None)]
    signals = per.filter("recognized").groupBy("candidate_id", "disposition").agg(n())
    by = [("uniqueRecognizedSignals", "SIGNAL", F.count(one), None), ("uniqueConfirmedSignals", "SIGNAL", hit("disposition = 'confirmed'"), None), ("uniqueFpSignals", "SIGNAL", hit("disposition = 'fp'"), None),
          ("uniqueUnconfirmedSignals", "SIGNAL", hit("disposition IN ('pc', 'none')"), None)]
    stars = per.groupBy("star_id", "user_id").agg(F.bool_or("viewed").alias("viewed")).groupBy("star_id").agg(n("started"), nif("viewed", "unlocked"))
    opened = [("discoveredStars", "STAR", F.sum("unlocked"), None), ("uniqueDiscoveredStars", "STAR", hit("unlocked > 0"), None), ("startedStars", "STAR", F.sum("started"), None)]
    done = completion(t).filter("stage = 'completed'").join(active, "user_id", "left_semi").groupBy("star_id").agg(n("done"))
    closed = [("currentCompletedStars", "STAR", F.sum("done"), None), ("uniqueCurrentCompletedStars", "STAR", F.count(one), None)]
    rows = st.kpi_counts(per, heads).unionByName(st.kpi_counts(signals, by)).unionByName(st.kpi_counts(stars, opened)).unionByName(st.kpi_counts(done, closed))
    return st.kpi_values(rows, unknown=("aiAttemptUnknown",))


@query("ag06_kpi_report", REPORT + " SELECT * FROM kv", "sub mem disp posts", D)
def _(t):
    return kpi_report(t)


@query("ag06_kpi_document", REPORT + """ SELECT '{' || string_agg('"' || key || '":{"unit":"' || unit || '","value":' || coalesce(CAST(CAST(value AS DECIMAL(24,6)) AS VARCHAR), 'null') || ',"numerator":' || numerator || ',"denominator":' || coalesce(CAST(denominator AS VARCHAR), 'null') || ',"status":"' || status || '","reason":' || coalesce('"' || reason || '"', 'null') || '}', ',' ORDER BY key) || '}' AS metrics FROM kv""", "sub mem disp posts", D)
def _(t):
    text = lambda c: F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("null"))
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    item = F.concat(text("key"), F.lit(':{"unit":'), text("unit"), F.lit(',"value":'), number(F.col("value").cast("decimal(24,6)")), F.lit(',"numerator":'), number(F.col("numerator")),
                    F.lit(',"denominator":'), number(F.col("denominator")), F.lit(',"status":'), text("status"), F.lit(',"reason":'), text("reason"), F.lit("}"))
    # The list of KPIs is fixed, so the document has a fixed length.
    items = F.transform(F.array_sort(F.collect_list(F.struct("key", item.alias("item")))), lambda r: r["item"])
    return kpi_report(t).agg(F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}")).alias("metrics"))


@query("ag07_first_match_accuracy", KPI_SQL.replace("act AS (SELECT sub.* FROM sub JOIN mem USING (user_id) WHERE status='active')", "act AS (SELECT * FROM sub)") + " SELECT user_id, count(*) AS graded, count(*) FILTER (agrees) AS agreed FROM g GROUP BY 1", "sub disp", D)
def _(t):
    return st.graded_first_matches(t.submissions(), t.dispositions()).groupBy("user_id").agg(n("graded"), nif("agrees", "agreed"))


@query("ag08_vote_distribution", ", v AS (SELECT *, row_number() OVER (PARTITION BY user_id, candidate_id ORDER BY created_at DESC, id DESC) AS rn FROM sub) SELECT candidate_id, judgment, count(*) AS votes, round(100.0*count(*)/sum(count(*)) OVER (PARTITION BY candidate_id),6) AS share FROM v WHERE rn=1 GROUP BY candidate_id, judgment", "sub", D)
def _(t):
    v = st.votes(t.submissions(), ["user_id", "candidate_id"]).groupBy("candidate_id", "judgment").agg(n("votes"))
    total = v.groupBy("candidate_id").agg(F.sum("votes").alias("total"))
    return v.join(total, "candidate_id").select("candidate_id", "judgment", "votes", F.round(100.0 * F.col("votes") / F.col("total"), 6).alias("share"))


AS_OF = "TIMESTAMP '2024-01-31'"
MM = KPI_SQL.replace("act AS (SELECT sub.* FROM sub JOIN mem USING (user_id) WHERE status='active')", f"act AS (SELECT * FROM sub WHERE created_at<{AS_OF})") + f""",
cs AS (SELECT id, user_id, CASE WHEN id%5=0 THEN 'no_signal' ELSE 'candidate' END AS kind, CASE id%4 WHEN 0 THEN ['oddeven','ushape'] WHEN 1 THEN ['secondary','oddeven','oddeven'] ELSE [] END AS checks FROM act),
ce AS (SELECT user_id, count(*) AS evidence FROM (SELECT DISTINCT id, user_id, e FROM (SELECT id, user_id, unnest(checks) AS e FROM cs WHERE kind='candidate') WHERE e IN ('oddeven','secondary','ushape')) GROUP BY 1), cn AS (SELECT user_id, count(*) FILTER (kind='candidate') AS candidates FROM cs GROUP BY 1),
mm AS (SELECT m.user_id, coalesce(agreed,0) AS agreed, coalesce(graded,0) AS graded, coalesce(submissions,0) AS submissions, coalesce(stars,0) AS stars, coalesce(candidates,0) AS candidates, coalesce(evidence,0) AS evidence, coalesce(recognized,0) AS recognized, coalesce(harmonic,0) AS harmonic FROM mem m LEFT JOIN ce USING (user_id) LEFT JOIN cn USING (user_id)
 LEFT JOIN (SELECT user_id, count(*) FILTER (agrees) AS agreed, count(*) AS graded FROM g GROUP BY 1) a USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS submissions, count(DISTINCT star_id) AS stars FROM act GROUP BY 1) b USING (user_id)
 LEFT JOIN (SELECT user_id, count(*) AS recognized, count(*) FILTER (match_result='matched_harmonic') AS harmonic FROM fm WHERE rn=1 GROUP BY 1) h USING (user_id)),
mr AS (SELECT user_id, 'firstMatchAccuracy' AS metric, agreed*100.0/nullif(graded,0) AS value FROM mm UNION ALL SELECT user_id, 'submissionsPerStar', submissions*1.0/nullif(stars,0) FROM mm UNION ALL SELECT user_id, 'harmonicRecognitionRate', harmonic*100.0/nullif(recognized,0) FROM mm UNION ALL SELECT user_id, 'evidencePerSubmission', evidence*1.0/nullif(candidates,0) FROM mm),
coh AS (SELECT DISTINCT user_id FROM sub JOIN mem USING (user_id) WHERE status='active' AND created_at>={AS_OF}-INTERVAL 10 DAY AND created_at<{AS_OF})"""


def as_of(days=0):
    return F.expr(f"timestamp_ntz'2024-01-31 00:00:00' - interval {days} days")


def member_metrics(t):
    subs = t.submissions().filter(F.col("created_at") < as_of())
    turn = F.col("id") % 4
    checks = F.when(turn == 0, '["oddeven","ushape"]').when(turn == 1, '["secondary","oddeven","oddeven"]').when(turn == 2, '{"x":1}')
    subs = subs.withColumns({"kind": F.when(F.col("id") % 5 == 0, "no_signal").otherwise("candidate"), "checks": checks})
    return st.member_metrics(t.members(), subs, t.dispositions())


def cohort_rows(t):
    """Metric rows of all members, and those of the active members of the last ten days."""
    rows = cut_lineage(st.metric_rows(member_metrics(t)))
    return rows, rows.join(st.active_cohort(t.members(), t.submissions(), as_of(10), as_of()), "user_id", "left_semi")


@query("ag09_member_metrics", MM + " SELECT * FROM mm", "sub mem disp", D)
def _(t):
    return member_metrics(t)


@query("ag10_cohort_medians", MM + ", k(metric, unit) AS (VALUES ('firstMatchAccuracy','PERCENT'), ('submissionsPerStar','SUBMISSIONS_PER_STAR'), ('harmonicRecognitionRate','PERCENT'), ('evidencePerSubmission','CHECKS_PER_SUBMISSION')) SELECT metric, unit, (SELECT count(*) FROM coh) AS n_cohort, count(value) AS n_members, round(median(value),8) AS median, CASE WHEN count(value)=0 THEN 'NO_SAMPLE' ELSE 'AVAILABLE' END AS status FROM k LEFT JOIN (SELECT * FROM mr WHERE user_id IN (SELECT user_id FROM coh)) USING (metric) GROUP BY metric, unit", "sub mem disp", D)
def _(t):
    return st.cohort_medians(cohort_rows(t)[1]).withColumn("median", F.round("median", 8))


@query("ag11_activity_by_local_day", "SELECT user_id, count(*) AS submissions, count(DISTINCT star_id) AS started, count(DISTINCT CAST(created_at + INTERVAL 9 HOUR AS DATE)) AS days FROM sub GROUP BY 1", "sub")
def _(t):
    return t.submissions().groupBy("user_id").agg(n("submissions"), F.count_distinct("star_id").alias("started"), F.count_distinct(local_date(F.col("created_at"))).alias("days"))


@query("ag12_recognition_after_retry",
       """, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, candidate_id ORDER BY created_at, id) AS rn FROM sub WHERE match_result IN ('matched','matched_harmonic')) WHERE rn=1),
       r AS (SELECT user_id, candidate_id, max(created_at) AS last_at FROM sub WHERE match_result='duplicate' GROUP BY ALL)
       SELECT f.user_id, count(*) FILTER (f.judgment IN ('UNLIKELY','UNSURE')) AS recognized, count(*) FILTER (d.answer_class IS NULL) AS missing FROM f JOIN r ON r.user_id=f.user_id AND r.candidate_id=f.candidate_id AND r.last_at>f.created_at LEFT JOIN disp d ON d.candidate_id=f.candidate_id GROUP BY f.user_id""", "sub disp", D)
def _(t):
    s = t.submissions()
    rank = F.struct("created_at", "id")
    x = s.groupBy("user_id", "candidate_id").agg(F.min_by(F.struct("judgment", "created_at"), F.when(F.col("match_result").isin(*st.MATCHES), rank)).alias("f"),
                                                 F.max(F.when(F.col("match_result") == "duplicate", F.col("created_at"))).alias("last_at"))
    x = x.filter(F.col("last_at") > F.col("f.created_at")).join(t.dispositions(), "candidate_id", "left")
    return x.groupBy("user_id").agg(nif(F.col("f.judgment").isin("UNLIKELY", "UNSURE"), "recognized"), nif("answer_class IS NULL", "missing"))


@query("ag13_evidence_usage",
       """ev AS (SELECT event_id, value, CASE event_id%4 WHEN 0 THEN ['oddeven','ushape'] WHEN 1 THEN ['secondary','oddeven'] ELSE [] END AS checks FROM events), x AS (SELECT event_id, value, unnest(checks) AS k FROM ev)
       SELECT keys.k AS key, count(event_id) AS uses, count(event_id) FILTER (value>=20) AS graded, count(event_id) FILTER (value>=60) AS agreed FROM (VALUES ('oddeven'),('secondary'),('ushape')) keys(k) LEFT JOIN x ON x.k=keys.k GROUP BY keys.k""".replace("ev AS", "WITH ev AS", 1))
def _(t):
    x = evidence(t).select("event_id", "value", F.explode(F.array_distinct(json_strings(F.col("checks")))).alias("key"))
    use = x.groupBy("key").agg(n("uses"), nif("value >= 20", "graded"), nif("value >= 60", "agreed"))
    keys = t.spark.createDataFrame([("oddeven",), ("secondary",), ("ushape",)], "key string")
    return keys.join(use, "key", "left").fillna(0)


@query("ag14_ordered_ids_and_first", "SELECT user_id, star_id, id, row_number() OVER w AS ordinal, first_value(match_result) OVER w AS first_result FROM sub WINDOW w AS (PARTITION BY user_id, star_id ORDER BY created_at, id)", "sub")
def _(t):
    pair = ["user_id", "star_id"]
    s = t.submissions().select(*pair, "created_at", "id", "match_result")
    first = s.groupBy(*pair).agg(F.min_by("match_result", F.struct("created_at", "id")).alias("first_result"))
    x = numbered(s, pair, ["created_at", "id"], F.to_date("created_at"), "ordinal").join(first, pair)
    return x.select(*pair, "id", "ordinal", "first_result")


@query("ag15_having_participants", "SELECT candidate_id, count(DISTINCT user_id) AS users FROM sub GROUP BY 1 HAVING count(DISTINCT user_id)>=75", "sub")
def _(t):
    return t.submissions().groupBy("candidate_id").agg(F.count_distinct("user_id").alias("users")).filter("users >= 75")


@query("ag16_bounds", "SELECT p_type, min(p_retailprice) AS x0, max(p_retailprice) AS x1, min(p_size) AS y0, max(p_size) AS y1 FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_type").agg(F.min("p_retailprice").alias("x0"), F.max("p_retailprice").alias("x1"), F.min("p_size").alias("y0"), F.max("p_size").alias("y1"))


@query("ag17_completion_by_part", """, u AS (SELECT DISTINCT part_id, series_id FROM obs), p AS (SELECT series_id FROM obs GROUP BY 1 HAVING count(*) FILTER (q=0)>=55) SELECT part_id, count(*) AS denominator, count(p.series_id) AS numerator FROM u LEFT JOIN p USING (series_id) GROUP BY part_id""", "obs", D)
def _(t):
    x = t.obs().groupBy("series_id", "part_id").agg(F.count_if(F.col("q") == 0).alias("ok"))
    done = x.groupBy("series_id").agg((F.sum("ok") >= 55).alias("done"))
    return x.join(done, "series_id").groupBy("part_id").agg(n("denominator"), nif("done", "numerator"))


ROUND = "rounds AS (SELECT n_nationkey AS round_id, n_regionkey AS round_no, n_nationkey*4 AS target FROM nation WHERE n_nationkey%5<>4), v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, candidate_id ORDER BY created_at DESC, id DESC) AS rn FROM sub) WHERE rn=1)"


def rounds(t):
    return t.nation.filter("n_nationkey % 5 <> 4").select(F.col("n_nationkey").alias("round_id"), F.col("n_regionkey").alias("round_no"), (F.col("n_nationkey") * 4).cast("bigint").alias("candidate_id"))


@query("ag18_campaign_participation", "SELECT round_id, round_no, count(DISTINCT user_id) AS members, count(user_id) AS participations, count(*) FILTER (judgment='LIKELY') AS likely, count(*) FILTER (judgment='UNLIKELY') AS unlikely, count(*) FILTER (judgment='UNSURE') AS unsure FROM rounds LEFT JOIN v ON candidate_id=target GROUP BY 1,2", "sub", ROUND)
def _(t):
    v = st.votes(t.submissions(), ["user_id", "candidate_id"])
    x = v.groupBy("candidate_id").agg(F.count_distinct("user_id").alias("members"), n("participations"), nif("judgment = 'LIKELY'", "likely"), nif("judgment = 'UNLIKELY'", "unlikely"), nif("judgment = 'UNSURE'", "unsure"))
    return rounds(t).join(x, "candidate_id", "left").fillna(0).drop("candidate_id")


@query("ag19_grade_distribution", "SELECT CASE WHEN k>=60 THEN 'expert' WHEN k>=40 THEN 'skilled' ELSE 'novice' END AS grade, count(*) AS members, CAST(sum(k) AS BIGINT) AS achievements FROM (SELECT user_id, count(DISTINCT candidate_id) AS k FROM sub GROUP BY 1) GROUP BY 1", "sub")
def _(t):
    x = t.submissions().groupBy("user_id").agg(F.count_distinct("candidate_id").alias("k"))
    grade = F.when(F.col("k") >= 60, "expert").when(F.col("k") >= 40, "skilled").otherwise("novice")
    return x.groupBy(grade.alias("grade")).agg(n("members"), F.sum("k").alias("achievements"))


def completion(t):
    s = t.submissions()
    c = t.supplier.select(F.col("s_suppkey").alias("candidate_id"), F.floor(F.col("s_suppkey") / 5).alias("star_id"), (F.col("s_acctbal") > 1000).alias("d"))
    kids = c.groupBy("star_id").agg(n("active"), nif("d", "n_disc"))
    found = (s.filter(F.col("match_result").isin(*st.MATCHES)).select("user_id", "candidate_id").distinct().join(c, "candidate_id")
             .groupBy("user_id", "star_id").agg(nif("d", "f_disc"), nif("not d", "f_hid")))
    x = s.select("user_id", "star_id").distinct().join(kids, "star_id").join(found, ["user_id", "star_id"], "left").fillna(0)
    x = x.withColumns({"open": F.col("n_disc") - F.col("f_disc"), "hidden": F.col("active") - F.col("n_disc") - F.col("f_hid")})
    stage = F.when(F.col("open") > 0, "analysis").when(F.col("hidden") > 0, "completed_with_hidden").otherwise("completed")
    return x.select("user_id", "star_id", "active", "open", "hidden", stage.alias("stage"))


@query("ag20_completion_decision", STAGES + " SELECT * FROM stg", "sub", D)
def _(t):
    return completion(t)


@query("ag21_judgement_summary", ", v AS (SELECT *, row_number() OVER (PARTITION BY user_id, candidate_id ORDER BY created_at DESC, id DESC) AS rn FROM sub) SELECT candidate_id, count(*) AS total, count(*) FILTER (judgment='LIKELY') AS likely, round(count(*) FILTER (judgment='LIKELY')*100.0/count(*),1) AS likely_pct FROM v WHERE rn=1 GROUP BY 1", "sub", D)
def _(t):
    x = st.votes(t.submissions(), ["user_id", "candidate_id"]).groupBy("candidate_id").agg(n("total"), nif("judgment = 'LIKELY'", "likely"))
    return x.withColumn("likely_pct", F.round(F.col("likely") * 100.0 / F.col("total"), 1))


@query("ag22_merge_conflicts", "SELECT star_id, count(*) AS conflicting FROM (SELECT user_id, star_id FROM sub WHERE match_result='matched' GROUP BY ALL HAVING count(DISTINCT candidate_id)>1) GROUP BY star_id", "sub")
def _(t):
    x = t.submissions().filter("match_result = 'matched'").groupBy("user_id", "star_id").agg(F.count_distinct("candidate_id").alias("c"))
    return x.filter("c > 1").groupBy("star_id").agg(n("conflicting"))


@query("ag23_change_fingerprint", " SELECT user_id, count(*) AS n_rows, " + set_digest_sql("""'{"candidate_id":' || candidate_id || ',"id":' || id || ',"judgment":"' || judgment || '"}'""") + " AS digest FROM latest GROUP BY 1", "sub", LATEST)
def _(t):
    return record_set_digest(latest_matches(t), ["user_id"], ["id", "candidate_id", "judgment"])


@query("ag24_run_roll_up", """, s AS (SELECT series_id, CASE WHEN count(*) FILTER (q=0)>=60 THEN 'ready' WHEN count(*) FILTER (q=0)>=50 THEN 'held' ELSE 'no_signal' END AS status FROM obs GROUP BY 1)
       SELECT coalesce(status,'unprocessed') AS status, count(*) AS n, count(*) FILTER (c_acctbal<0) AS negative FROM customer LEFT JOIN s ON series_id=c_custkey GROUP BY 1""", "obs", D)
def _(t):
    ok = F.count_if(F.col("q") == 0)
    s = t.obs().groupBy(F.col("series_id").alias("c_custkey")).agg(F.when(ok >= 60, "ready").when(ok >= 50, "held").otherwise("no_signal").alias("status"))
    x = t.customer.select("c_custkey", "c_acctbal").join(s, "c_custkey", "left")
    return x.groupBy(F.coalesce("status", F.lit("unprocessed")).alias("status")).agg(n(), nif("c_acctbal < 0", "negative"))


@query("ag25_supply_report", """SELECT n_regionkey AS region, count(*) AS offered, count(*) FILTER (k IS NOT NULL) AS ready, count(*) FILTER (k IS NULL) AS missing, count(*) FILTER (s_acctbal<0) AS excluded, CASE WHEN count(*) FILTER (k IS NOT NULL AND s_acctbal>=0)>=15 THEN 'sufficient' ELSE 'short' END AS verdict
       FROM supplier JOIN nation ON n_nationkey=s_nationkey LEFT JOIN (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity=50 AND l_discount=0.1) ON k=s_suppkey GROUP BY 1""")
def _(t):
    k = t.lineitem.filter((F.col("l_quantity") == 50) & (F.col("l_discount") == 0.1)).select(F.col("l_suppkey").alias("s_suppkey"), F.lit(True).alias("k")).distinct()
    x = t.supplier.join(small(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).join(k, "s_suppkey", "left")
    good = F.count_if(F.col("k").isNotNull() & (F.col("s_acctbal") >= 0))
    return x.groupBy(F.col("n_regionkey").alias("region")).agg(n("offered"), nif("k IS NOT NULL", "ready"), nif("k IS NULL", "missing"), nif("s_acctbal < 0", "excluded"), F.when(good >= 15, "sufficient").otherwise("short").alias("verdict"))


@query("ag26_population_summary", "SELECT lang, count(*) AS selected, count(quality) AS valid, count(*) FILTER (toxic=1) AS failed, round(1.0*count(*) FILTER (quality=0)/nullif(count(quality),0),8) AS low_fraction FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(t):
    x = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").groupBy("lang").agg(n("selected"), F.count("quality").alias("valid"), nif("toxic = 1", "failed"), nif("quality = 0", "low"))
    return x.select("lang", "selected", "valid", "failed", F.round(F.try_divide("low", "valid"), 8).alias("low_fraction"))


SC = "sc AS (SELECT doc_id, source, lang, quality=1 AS positive, toxic, least(n_chars,8000)/8000.0 AS score FROM documents JOIN labels USING (doc_id))"


def scored(t):
    return t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels, "doc_id").select(
        "doc_id", "source", "lang", (F.col("quality") == 1).alias("positive"), "toxic", (F.least(F.col("n_chars"), F.lit(8000)) / 8000.0).alias("score"))


@query("ag28_marginal_cross_tabs", "SELECT lang, positive, count(*) AS n, round(avg(score),8) AS mean_score FROM sc GROUP BY CUBE (lang, positive)", ctes=SC)
def _(t):
    return scored(t).cube("lang", "positive").agg(n(), F.round(F.avg("score"), 8).alias("mean_score"))


@query("ag30_precision_recall_curve", """, g AS (SELECT score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS f FROM sc GROUP BY 1), c AS (SELECT score, sum(p) OVER w AS tp, sum(f) OVER w AS fp, (SELECT count(*) FROM sc WHERE positive) AS np FROM g WINDOW w AS (ORDER BY score DESC))
       SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp*1.0/(tp+fp),8) AS precision, round(tp*1.0/np,8) AS recall FROM c""", ctes=SC)
def _(t):
    return st.precision_recall(scored(t)).select("threshold", "tp", "fp", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


@query("ag30_average_precision", """, g AS (SELECT score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS f FROM sc GROUP BY 1), c AS (SELECT score, sum(p) OVER w AS tp, sum(f) OVER w AS fp, (SELECT count(*) FROM sc WHERE positive) AS np, (SELECT count(*) FROM sc WHERE NOT positive) AS nn FROM g WINDOW w AS (ORDER BY score DESC)),
       r AS (SELECT score, tp*1.0/np AS rec, tp*1.0/(tp+fp) AS pre, np, nn FROM c), d AS (SELECT *, coalesce(lag(rec) OVER (ORDER BY score DESC),0) AS r0, coalesce(lag(pre) OVER (ORDER BY score DESC),1) AS p0 FROM r)
       SELECT any_value(np) AS n_positive, any_value(nn) AS n_negative, round(sum((rec-r0)*pre),8) AS average_precision, round(sum((rec-r0)*(pre+p0)/2),8) AS pr_auc_trapezoid FROM d""", ctes=SC)
def _(t):
    return st.average_precision(st.precision_recall(scored(t)))


@query("ag30_threshold_counts", "SELECT x AS threshold, count(*) FILTER (positive AND score>=x) AS tp, count(*) FILTER (NOT positive AND score>=x) AS fp, count(*) FILTER (positive AND score<x) AS fn, count(*) FILTER (NOT positive AND score<x) AS tn FROM sc, (VALUES (0.1::DOUBLE),(0.25),(0.5),(0.75)) z(x) GROUP BY x", ctes=SC)
def _(t):
    return st.threshold_table(scored(t), [0.1, 0.25, 0.5, 0.75])


@query("ag31_evaluation_summary", """SELECT positive, count(*) AS total, count(*) FILTER (toxic=0) AS scored, count(*) FILTER (toxic=1) AS failures, count(*) FILTER (toxic=0 AND score<0.2) AS below, count(*) FILTER (toxic=0 AND score>=0.2 AND score<0.6) AS review, count(*) FILTER (toxic=0 AND score>=0.6) AS approved, count(*)-count(DISTINCT doc_id) AS duplicates FROM sc GROUP BY 1""", ctes=SC)
def _(t):
    return scored(t).groupBy("positive").agg(n("total"), nif("toxic = 0", "scored"), nif("toxic = 1", "failures"), nif("toxic = 0 AND score < 0.2", "below"), nif("toxic = 0 AND score >= 0.2 AND score < 0.6", "review"),
                                             nif("toxic = 0 AND score >= 0.6", "approved"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("duplicates"))


@query("ag34_medians_by_class", "SELECT l_returnflag, l_linestatus, median(l_extendedprice) FILTER (l_quantity>=25) AS med_large, median(l_extendedprice) FILTER (l_quantity<25) AS med_small FROM lineitem GROUP BY ALL")
def _(t):
    k = ["l_returnflag", "l_linestatus"]
    x = t.lineitem.select(*k, "l_quantity", "l_extendedprice")
    # The class joins the key: one exact-median pass serves both columns.
    m = grouped_median(x.withColumn("large", F.col("l_quantity") >= 25), k + ["large"], F.col("l_extendedprice"), "m")
    return m.groupBy(*k).agg(F.max(F.when(F.col("large"), F.col("m"))).alias("med_large"), F.max(F.when(~F.col("large"), F.col("m"))).alias("med_small"))


@query("ag35_latest_activity", """SELECT c_custkey, greatest(o.t, e.t) AS last_activity, coalesce(o.n,0) AS n_orders, coalesce(e.n,0) AS n_events FROM customer LEFT JOIN (SELECT o_custkey AS k, max(o_orderdate) AS t, count(*) AS n FROM orders GROUP BY 1) o ON o.k=c_custkey LEFT JOIN (SELECT user_id AS k, max(ts) AS t, count(*) AS n FROM events GROUP BY 1) e ON e.k=c_custkey""")
def _(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("ot"), n("n_orders"))
    e = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("et"), n("n_events"))
    x = t.customer.select("c_custkey").join(o, "c_custkey", "left").join(e, "c_custkey", "left")
    return x.select("c_custkey", F.greatest("ot", "et").alias("last_activity"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


@query("ag36_campaign_participants", "SELECT round_no, count(DISTINCT user_id) AS participants FROM rounds JOIN sub ON candidate_id=target WHERE match_result<>'not_matched' GROUP BY 1", "sub", ROUND.split(", v AS")[0])
def _(t):
    x = t.submissions().filter("match_result <> 'not_matched'").select("user_id", "candidate_id").distinct().join(small(rounds(t)), "candidate_id")
    return x.select("round_no", "user_id").distinct().groupBy("round_no").agg(n("participants"))


@query("ag37_unpublished_matches", "SELECT user_id, count(DISTINCT candidate_id) AS unpublished FROM sub s WHERE match_result IN ('matched','matched_harmonic') AND NOT EXISTS (SELECT 1 FROM sub p WHERE p.user_id=s.user_id AND p.candidate_id=s.candidate_id AND p.match_result='ambiguous_match') GROUP BY 1", "sub")
def _(t):
    x = t.submissions().groupBy("user_id", "candidate_id").agg(F.bool_or(F.col("match_result").isin(*st.MATCHES)).alias("m"), F.bool_or(F.col("match_result") == "ambiguous_match").alias("p"))
    return x.filter("m and not p").groupBy("user_id").agg(n("unpublished"))


@query("ag38_community_counts", """SELECT author_id, count(DISTINCT post_id) AS posts, CAST(coalesce(sum(c),0) AS BIGINT) AS comments FROM posts LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem WHERE l_linestatus='O' GROUP BY 1) k ON l_orderkey=post_id WHERE status='visible' GROUP BY 1""", "posts")
def _(t):
    c = t.lineitem.filter("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("post_id")).agg(n("c"))
    return t.posts().filter("status = 'visible'").join(c, "post_id", "left").groupBy("author_id").agg(n("posts"), F.coalesce(F.sum("c"), F.lit(0)).alias("comments"))


@query("ag39_reaction_tally", "SELECT candidate_id, count(*) FILTER (match_result='matched') AS agree, count(*) FILTER (match_result='not_matched') AS disagree, bool_or(user_id=7 AND match_result='matched') AS own FROM sub GROUP BY 1", "sub")
def _(t):
    return t.submissions().groupBy("candidate_id").agg(nif("match_result = 'matched'", "agree"), nif("match_result = 'not_matched'", "disagree"), F.bool_or((F.col("user_id") == 7) & (F.col("match_result") == "matched")).alias("own"))


@query("ag40_sample_profile", "SELECT source, count(*) AS files, min(n_chars) AS bytes_min, round(avg(n_chars),8) AS bytes_mean, max(n_chars) AS bytes_max, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(n("files"), F.min("n_chars").alias("bytes_min"), F.round(F.avg("n_chars"), 8).alias("bytes_mean"), F.max("n_chars").alias("bytes_max"), F.concat_ws(",", F.sort_array(F.collect_set("lang"))).alias("langs"))


@query("ag41_label_split_crosstab", "SELECT lang, count(*) FILTER (quality=1 AND doc_id%2=0) AS q1_calibration, count(*) FILTER (quality=1 AND doc_id%2=1) AS q1_evaluation, count(*) FILTER (quality=0) AS q0 FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def _(t):
    x = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").withColumn(
        "cell", F.when(F.col("quality") == 0, "q0").when(F.col("doc_id") % 2 == 0, "q1_calibration").otherwise("q1_evaluation"))
    return x.groupBy("lang").pivot("cell", ["q0", "q1_calibration", "q1_evaluation"]).count().fillna(0)


@query("ag42_step_audit", """, k AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p FROM lineitem GROUP BY ALL), d AS (SELECT l_orderkey, count(*) AS declared, max(l_linenumber) AS top FROM k GROUP BY 1), pr AS (SELECT a.l_orderkey, count(*) AS pairs, count(*) FILTER (a.p<b.p) AS rising FROM k a JOIN k b ON a.l_orderkey=b.l_orderkey AND a.l_linenumber+1=b.l_linenumber GROUP BY 1)
       SELECT d.l_orderkey, declared, top, declared=top AS consistent, coalesce(pairs,0) AS pairs, coalesce(rising,0) AS rising FROM d LEFT JOIN pr USING (l_orderkey)""", ctes=D)
def _(t):
    k = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    d = k.groupBy("l_orderkey").agg(n("declared"), F.max("l_linenumber").alias("top"))
    # Neighbouring steps meet by an equi-join on the shifted step number.
    nxt = k.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("p").alias("p2"))
    pr = k.join(nxt, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey").agg(n("pairs"), nif("p < p2", "rising"))
    return d.join(pr, "l_orderkey", "left").select("l_orderkey", "declared", "top", (F.col("declared") == F.col("top")).alias("consistent"), F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("rising", F.lit(0)).alias("rising"))


@query("ag44_sensitivity_summary", "SELECT cap, count(*) FILTER (c<=cap) AS pass, count(*) AS total FROM (SELECT user_id, count(*) AS c FROM events GROUP BY 1), (VALUES (60),(66),(72),(80)) z(cap) GROUP BY cap")
def _(t):
    hist = t.events.groupBy("user_id").agg(n("c")).groupBy("c").agg(n("k"))
    x = hist.select("c", "k", F.explode(F.array(*[F.lit(v) for v in (60, 66, 72, 80)])).alias("cap"))
    return x.groupBy("cap").agg(F.coalesce(F.sum(F.when(F.col("c") <= F.col("cap"), F.col("k"))), F.lit(0)).alias("pass"), F.sum("k").alias("total"))


@query("ag45_reproduction_verdict", """SELECT l_returnflag, median(r) AS median_diff, round(avg(CASE WHEN r>0.07 THEN 1.0 ELSE 0.0 END),8) AS share_over, max(r) AS max_diff, median(r)<=0.05 AND max(r)<=0.1 AS ok FROM (SELECT l_returnflag, abs(l_discount-l_tax) AS r FROM lineitem) GROUP BY 1""")
def _(t):
    x = t.lineitem.select("l_returnflag", F.abs(F.col("l_discount") - F.col("l_tax")).alias("r"))
    s = x.groupBy("l_returnflag").agg(F.round(F.avg(F.when(F.col("r") > 0.07, 1.0).otherwise(0.0)), 8).alias("share_over"), F.max("r").alias("max_diff"))
    m = grouped_median(x, "l_returnflag", F.col("r"), "median_diff")
    return s.join(m, "l_returnflag").withColumn("ok", (F.col("median_diff") <= 0.05) & (F.col("max_diff") <= 0.1))


@query("ag46_measurability_summary", "SELECT kind, count(*) AS n, count(*) FILTER (v>=20) AS measured, round(1.0*count(*) FILTER (v<20)/count(*),8) AS no_peak_share, count(*) FILTER (v>=60) AS discoverable FROM (SELECT CASE WHEN q=1 THEN 'control' ELSE 'candidate' END AS kind, v FROM obs) GROUP BY 1", "obs")
def _(t):
    x = t.obs().groupBy(F.when(F.col("q") == 1, "control").otherwise("candidate").alias("kind")).agg(n(), nif("v >= 20", "measured"), nif("v < 20", "low"), nif("v >= 60", "discoverable"))
    return x.select("kind", "n", "measured", F.round(F.col("low") / F.col("n"), 8).alias("no_peak_share"), "discoverable")


@query("ag47_source_audit", "SELECT l_suppkey, CAST(sum(c) AS BIGINT) AS rows_selected, count(*) AS keys, count(*) FILTER (c>1) AS duplicate_keys FROM (SELECT l_suppkey, l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY 1")
def _(t):
    x = t.lineitem.groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(n("c"))
    return x.groupBy("l_suppkey").agg(F.sum("c").alias("rows_selected"), n("keys"), nif("c > 1", "duplicate_keys"))


@query("ag48_member_versus_baseline", MM + """, md AS (SELECT metric, median(value) AS baseline FROM mr WHERE user_id IN (SELECT user_id FROM coh) GROUP BY 1) SELECT user_id, metric, round(value,8) AS value, round(baseline,8) AS baseline, CASE WHEN value IS NULL THEN 'no_sample' WHEN baseline IS NULL THEN 'unavailable' WHEN value>baseline THEN 'above' WHEN value<baseline THEN 'below' ELSE 'equal' END AS verdict FROM mr JOIN md USING (metric)""", "sub mem disp", D)
def _(t):
    rows, cohort = cohort_rows(t)
    med = st.cohort_medians(cohort).select("metric", F.col("median").alias("baseline"))
    v, b = F.col("value"), F.col("baseline")
    verdict = F.when(v.isNull(), "no_sample").when(b.isNull(), "unavailable").when(v > b, "above").when(v < b, "below").otherwise("equal")
    # Four metrics: the baseline table has a fixed size.
    return rows.join(F.broadcast(med), "metric").select("user_id", "metric", F.round(v, 8).alias("value"), F.round(b, 8).alias("baseline"), verdict.alias("verdict"))
