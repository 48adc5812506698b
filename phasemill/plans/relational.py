"""Joins, pages and set operations."""

from pyspark.sql import functions as F

from phasemill.functions.scalars import local_week
from phasemill.operators import binning, cleaning, relational as rel
from phasemill.operators.ordered import latest, numbered
from phasemill.operators.rangejoin import overlap_join
from phasemill.plans.registry import query
from phasemill.plans.series import BINNED, half_day_grid

N = "count(*) AS n"


def n():
    return F.count(F.lit(1)).alias("n")


@query("jn01_semi_selection", "SELECT l_partkey, count(*) AS n, round(sum(l_extendedprice),2) AS total FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand='Brand#2') GROUP BY l_partkey")
def _(t):
    ids = t.part.filter("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("l_partkey"))
    rows = rel.select_rows(t.lineitem.select("l_partkey", "l_extendedprice"), ids, "l_partkey")
    return rows.groupBy("l_partkey").agg(n(), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("jn02_changed_entities", "SELECT series_id, part_id, count(*) AS n FROM obs WHERE series_id IN (SELECT series_id FROM obs WHERE part_id>=3 AND v>150) GROUP BY ALL", "obs")
def _(t):
    return rel.changed_entities(t.obs(), "series_id", (F.col("part_id") >= 3) & (F.col("v") > 150)).groupBy("series_id", "part_id").agg(n())


@query("jn03_key_reconciliation", """SELECT c_custkey AS key, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) UNION ALL
       SELECT DISTINCT user_id, 'unexpected' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def _(t):
    return rel.reconcile_keys(t.customer.select(F.col("c_custkey").alias("key")), t.events.select(F.col("user_id").alias("key")), "key")


@query("jn04_retry_selection", "SELECT series_id, count(*) AS n FROM obs WHERE series_id IN (SELECT series_id FROM obs GROUP BY series_id HAVING count(*) FILTER (q=0)<50) GROUP BY series_id", "obs")
def _(t):
    x = t.obs()
    failed = x.groupBy("series_id").agg(F.count_if(F.col("q") == 0).alias("ok")).filter("ok < 50").select("series_id")
    return x.join(failed, "series_id").groupBy("series_id").agg(n())


@query("jn05_left_outer_assembly",
       """SELECT c_custkey, c_name, coalesce(n_orders,0) AS n_orders, o.last_order, coalesce(n_events,0) AS n_events FROM customer
       LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, max(o_orderdate) AS last_order FROM orders GROUP BY 1) o ON o_custkey=c_custkey LEFT JOIN (SELECT user_id, count(*) AS n_events FROM events GROUP BY 1) e ON user_id=c_custkey""")
def _(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderdate").alias("last_order"))
    e = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_events"))
    zero = F.lit(0)
    return (t.customer.select("c_custkey", "c_name").join(o, "c_custkey", "left").join(e, "c_custkey", "left")
            .select("c_custkey", "c_name", F.coalesce("n_orders", zero).alias("n_orders"), "last_order", F.coalesce("n_events", zero).alias("n_events")))


@query("jn06_child_key_verification",
       """SELECT o_orderkey, coalesce(c.n,0) AS n_lines, CASE WHEN c.n IS NULL THEN 'no_children' WHEN c.n<>c.d THEN 'duplicate_child' WHEN c.m<>c.d THEN 'gap' ELSE 'ok' END AS verdict
       FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, max(l_linenumber) AS m FROM lineitem GROUP BY 1) c ON l_orderkey=o_orderkey""")
def _(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.count(F.lit(1)).alias("c"))
    kids = lines.groupBy("o_orderkey").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"), F.max("l_linenumber").alias("m"))
    verdict = F.when(F.col("n").isNull(), "no_children").when(F.col("n") != F.col("d"), "duplicate_child").when(F.col("m") != F.col("d"), "gap").otherwise("ok")
    return t.orders.select("o_orderkey").join(kids, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"), verdict.alias("verdict"))


@query("jn07_dictionary_enrichment", "SELECT n_name, r_name, count(*) AS n, round(sum(c_acctbal),2) AS balance FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY ALL")
def _(t):
    # nation and region are fixed dictionaries; balances are summed per nation before the names join.
    sums = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(n(), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    names = t.nation.join(rel.small(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return sums.join(rel.small(names), "n_nationkey").select("n_name", "r_name", "n", "balance")


@query("jn09_exists_pool",
       """SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey=p_partkey AND l_returnflag='R' AND l_quantity>47)
       AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey=p_partkey AND l_discount=0 AND l_tax=0) AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey=p_partkey AND l_linestatus='O')""")
def _(t):
    li = t.lineitem.withColumnRenamed("l_partkey", "p_partkey")
    # One pass over the children instead of three: the conditions become flags per key.
    flags = li.groupBy("p_partkey").agg(F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 47)).alias("a"),
                                        F.bool_or((F.col("l_discount") == 0) & (F.col("l_tax") == 0)).alias("b"), F.bool_or(F.col("l_linestatus") == "O").alias("c"))
    return t.part.select("p_partkey").join(flags.filter("not a and not b and c"), "p_partkey", "left_semi")


@query("jn10_impact_counts",
       """SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey=s_suppkey) AS lines, (SELECT count(*) FROM lineitem WHERE l_suppkey=s_suppkey AND l_returnflag='R') AS returned,
       (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_suppkey=s_suppkey) AS orders, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey=s_suppkey) AS parts,
       (SELECT count(*) FROM sub WHERE candidate_id=s_suppkey) AS submissions, (SELECT count(DISTINCT user_id) FROM sub WHERE candidate_id=s_suppkey) AS members FROM supplier""", "sub")
def _(t):
    li = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"))
    sub = t.submissions().groupBy(F.col("candidate_id").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("submissions"), F.count_distinct("user_id").alias("members"))
    return t.supplier.select("s_suppkey").join(li, "s_suppkey", "left").join(sub, "s_suppkey", "left").fillna(0)


@query("jn11_latest_child",
       """SELECT c_custkey, o_orderkey, CASE WHEN o_orderstatus='F' THEN o_totalprice END AS settled FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) o ON o_custkey=c_custkey AND rn=1""")
def _(t):
    last = latest(t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", ["o_orderdate", "o_orderkey"])
    return t.customer.select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("settled"))


@query("jn12_weekly_spine",
       """, w AS (SELECT u.user_id, CAST(d AS DATE) AS week_start FROM (SELECT DISTINCT user_id FROM sub) u, range(DATE '2023-12-11', DATE '2024-01-30', INTERVAL 7 DAY) r(d)),
       c AS (SELECT user_id, CAST(date_trunc('week', created_at + INTERVAL 9 HOUR) AS DATE) AS week_start, count(*) AS n FROM sub GROUP BY ALL)
       SELECT w.user_id, CAST(w.week_start AS VARCHAR) AS week_start, w.week_start=DATE '2024-01-29' AS partial, coalesce(c.n,0) AS submissions FROM w LEFT JOIN c USING (user_id, week_start)""", "sub", "dummy AS (SELECT 1)")
def _(t):
    s = t.submissions().select("user_id", "created_at")
    counts = s.groupBy("user_id", local_week(F.col("created_at")).alias("week_start")).agg(n())
    spine = rel.weekly_spine(s.select("user_id").distinct(), "2024-01-29", 8)
    return spine.join(counts, ["user_id", "week_start"], "left").select(
        "user_id", F.col("week_start").cast("string").alias("week_start"), "partial", F.coalesce("n", F.lit(0)).alias("submissions"))


EVENTS_OF = """
run AS (SELECT series_id, part_id, g AS run, min(centre) AS r0, max(centre) AS r1 FROM (SELECT *, bin-row_number() OVER (PARTITION BY series_id, part_id ORDER BY bin) AS g FROM grid WHERE flux IS NOT NULL) GROUP BY ALL)"""


def observed(t):
    return binning.runs(half_day_grid(t), empty=False).select("series_id", "part_id", "run", F.col("t_first").alias("r0"), F.col("t_last").alias("r1"))


@query("jn13_interval_overlap",
       """, w AS (SELECT series_id, 0.7::DOUBLE+k*3.3::DOUBLE AS c, 0.7::DOUBLE+k*3.3::DOUBLE-0.4 AS w0, 0.7::DOUBLE+k*3.3::DOUBLE+0.4 AS w1 FROM (SELECT DISTINCT series_id FROM obs), (SELECT unnest(range(10)) AS k))
       SELECT w.series_id, round(w.c,8) AS centre, count(*) AS n_runs, round(min(greatest(w0,r0)),8) AS lo FROM w JOIN run ON run.series_id=w.series_id AND greatest(w0,r0)<=least(w1,r1) GROUP BY w.series_id, w.c""", "obs", BINNED + "," + EVENTS_OF)
def _(t):
    w = t.obs().select("series_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    w = w.select("series_id", (0.7 + F.col("k") * 3.3).alias("c")).withColumns({"w0": F.col("c") - 0.4, "w1": F.col("c") + 0.4})
    hit = overlap_join(w, observed(t).drop("part_id"), ["series_id"], ("w0", "w1"), ("r0", "r1"), 2.0)
    return hit.groupBy("series_id", "c").agg(F.count(F.lit(1)).alias("n_runs"), F.round(F.min(F.greatest("w0", "r0")), 8).alias("lo")).select(
        "series_id", F.round("c", 8).alias("centre"), "n_runs", "lo")


@query("jn14_latest_state_star_join",
       """, l AS (SELECT *, row_number() OVER (PARTITION BY user_id, candidate_id ORDER BY created_at DESC, id DESC) AS rn FROM sub), r AS (SELECT user_id, candidate_id, count(*) AS tries, min(created_at) AS first_at FROM sub GROUP BY ALL)
       SELECT l.user_id, l.candidate_id, l.id, l.match_result, r.tries, r.first_at, d.disposition, d.truth, s.s_name, n.n_name, m.status FROM l JOIN r USING (user_id, candidate_id) LEFT JOIN disp d USING (candidate_id)
       LEFT JOIN supplier s ON s.s_suppkey=l.candidate_id LEFT JOIN nation n ON n.n_nationkey=s.s_nationkey LEFT JOIN mem m ON m.user_id=l.user_id WHERE rn=1""", "sub disp mem", "dummy AS (SELECT 1)")
def _(t):
    state = t.submissions().groupBy("user_id", "candidate_id").agg(
        F.max_by(F.struct("id", "match_result"), F.struct("created_at", "id")).alias("s"), F.count(F.lit(1)).alias("tries"), F.min("created_at").alias("first_at"))
    sup = t.supplier.select(F.col("s_suppkey").alias("candidate_id"), "s_name", F.col("s_nationkey").alias("n_nationkey")).join(rel.small(t.nation), "n_nationkey", "left")
    return (state.join(t.dispositions(), "candidate_id", "left").join(sup, "candidate_id", "left").join(t.members(), "user_id", "left")
            .select("user_id", "candidate_id", "s.id", "s.match_result", "tries", "first_at", "disposition", "truth", "s_name", "n_name", "status"))


@query("jn15_unpivot_metrics",
       """SELECT user_id, m AS metric, v FROM (SELECT user_id, count(*) AS submissions, count(DISTINCT star_id) AS stars, count(*) FILTER (match_result='matched') AS matched, count(*) FILTER (match_result='duplicate') AS duplicates FROM sub GROUP BY user_id)
       UNPIVOT INCLUDE NULLS (v FOR m IN (submissions, stars, matched, duplicates))""", "sub")
def _(t):
    x = t.submissions().groupBy("user_id").agg(F.count(F.lit(1)).alias("submissions"), F.count_distinct("star_id").alias("stars"),
                                               F.count_if(F.col("match_result") == "matched").alias("matched"), F.count_if(F.col("match_result") == "duplicate").alias("duplicates"))
    return x.unpivot("user_id", ["submissions", "stars", "matched", "duplicates"], "metric", "v")


@query("jn16_periodic_windows_clipped",
       """, k AS (SELECT *, unnest(range(CAST(ceil((r0-0.7-0.4)/3.3) AS BIGINT), CAST(floor((r1-0.7+0.4)/3.3) AS BIGINT)+1)) AS cyc FROM run)
       SELECT series_id, part_id, cyc, round(greatest(r0, 0.7+cyc*3.3-0.4),8) AS lo, round(least(r1, 0.7+cyc*3.3+0.4),8) AS hi FROM k WHERE greatest(r0, 0.7+cyc*3.3-0.4)<=least(r1, 0.7+cyc*3.3+0.4)""", "obs", BINNED + "," + EVENTS_OF)
def _(t):
    first = F.ceil((F.col("r0") - 0.7 - 0.4) / 3.3)
    last = F.floor((F.col("r1") - 0.7 + 0.4) / 3.3)
    x = observed(t).filter(first <= last).withColumn("cyc", F.explode(F.sequence(first, last)))
    c = 0.7 + F.col("cyc") * 3.3
    lo, hi = F.greatest(F.col("r0"), c - 0.4), F.least(F.col("r1"), c + 0.4)
    return x.filter(lo <= hi).select("series_id", "part_id", "cyc", F.round(lo, 8).alias("lo"), F.round(hi, 8).alias("hi"))


@query("jn17_evidence_agreement",
       """, e AS (SELECT o_orderkey AS k, o_orderstatus AS st, CAST(o_orderkey%5 AS BIGINT) AS n FROM orders), a AS (SELECT l_orderkey AS k, min(l_linestatus) AS st, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT coalesce(e.k,a.k) AS k, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' WHEN e.st IS DISTINCT FROM a.st OR e.n IS DISTINCT FROM a.n THEN 'differs' ELSE 'agrees' END AS verdict,
       concat_ws(',', CASE WHEN e.st IS DISTINCT FROM a.st THEN 'st' END, CASE WHEN e.n IS DISTINCT FROM a.n THEN 'n' END) AS fields FROM e FULL OUTER JOIN a ON e.k=a.k""", ctes="dummy AS (SELECT 1)")
def _(t):
    e = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st"), (F.col("o_orderkey") % 5).alias("n"))
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linestatus").alias("st"), n())
    return rel.evidence_agreement(e, a, ["k"], ["st", "n"])


FOLLOW = """fm AS (SELECT DISTINCT user_id, candidate_id AS target FROM sub WHERE match_result='matched_harmonic'), fs AS (SELECT DISTINCT user_id, star_id FROM sub WHERE match_result='ambiguous_match')"""


def follows(t):
    s = t.submissions()
    return (s.filter("match_result = 'matched_harmonic'").select("user_id", F.col("candidate_id").alias("target")).distinct(),
            s.filter("match_result = 'ambiguous_match'").select("user_id", "star_id").distinct())


@query("jn18_follow_feed",
       """, p AS (SELECT id, user_id AS author, star_id FROM sub WHERE match_result='matched'), a AS (SELECT author, star_id, count(*) AS n FROM p GROUP BY ALL),
       byauthor AS (SELECT fm.user_id, a.author, a.star_id, a.n FROM fm JOIN a ON a.author=fm.target), bystar AS (SELECT fs.user_id, a.author, a.star_id, a.n FROM fs JOIN a ON a.star_id=fs.star_id),
       j AS (SELECT coalesce(x.user_id,y.user_id) AS user_id, coalesce(x.n,y.n) AS n, x.n IS NOT NULL AS ba, y.n IS NOT NULL AS bs FROM byauthor x FULL OUTER JOIN bystar y ON x.user_id=y.user_id AND x.author=y.author AND x.star_id=y.star_id)
       SELECT user_id, CAST(sum(n) AS BIGINT) AS posts, CAST(coalesce(sum(n) FILTER (ba),0) AS BIGINT) AS by_author, CAST(coalesce(sum(n) FILTER (bs),0) AS BIGINT) AS by_star, CAST(coalesce(sum(n) FILTER (ba AND bs),0) AS BIGINT) AS by_both FROM j GROUP BY user_id""", "sub", FOLLOW)
def _(t):
    members, stars = follows(t)
    # Posts are counted per author, per star and per (author, star) before any edge
    # touches them; the union of both reasons is their sum less the overlap.
    cells = t.submissions().filter("match_result = 'matched'").groupBy(F.col("user_id").alias("target"), "star_id").agg(n())
    total = lambda d, name: d.groupBy("user_id").agg(F.sum("n").alias(name))
    a = total(members.join(cells.groupBy("target").agg(F.sum("n").alias("n")), "target"), "by_author")
    s = total(stars.join(cells.groupBy("star_id").agg(F.sum("n").alias("n")), "star_id"), "by_star")
    both = total(members.join(cells, "target").join(stars, ["user_id", "star_id"], "left_semi"), "by_both")
    x = a.join(s, "user_id", "full_outer").join(both, "user_id", "left").fillna(0)
    return x.withColumn("posts", F.col("by_author") + F.col("by_star") - F.col("by_both"))


@query("jn19_follow_counts",
       """, f AS (SELECT fm.* FROM fm JOIN mem a ON a.user_id=fm.user_id AND a.status='active' JOIN mem b ON b.user_id=fm.target AND b.status='active')
       SELECT m.user_id, coalesce(x.c,0) AS followers, coalesce(y.c,0) AS followed, coalesce(s.c,0) AS stars, coalesce(z.c,0) AS mutual FROM mem m LEFT JOIN (SELECT target, count(*) AS c FROM f GROUP BY 1) x ON x.target=m.user_id LEFT JOIN (SELECT user_id, count(*) AS c FROM f GROUP BY 1) y ON y.user_id=m.user_id
       LEFT JOIN (SELECT user_id, count(*) AS c FROM fs GROUP BY 1) s ON s.user_id=m.user_id LEFT JOIN (SELECT f.user_id, count(*) AS c FROM f JOIN f g ON f.user_id=g.target AND f.target=g.user_id GROUP BY 1) z ON z.user_id=m.user_id""", "sub mem", FOLLOW)
def _(t):
    members, stars = follows(t)
    active = t.members().filter("status = 'active'").select("user_id")
    f = members.join(active, "user_id", "left_semi").join(active.withColumnRenamed("user_id", "target"), "target", "left_semi")
    mutual = f.join(f.select(F.col("user_id").alias("target"), F.col("target").alias("user_id")), ["user_id", "target"], "left_semi")
    c = lambda d, k, name: d.groupBy(F.col(k).alias("user_id")).agg(F.count(F.lit(1)).alias(name))
    out = t.members().select("user_id")
    for d in (c(f, "target", "followers"), c(f, "user_id", "followed"), c(stars, "user_id", "stars"), c(mutual, "user_id", "mutual")):
        out = out.join(d, "user_id", "left")
    return out.fillna(0)


LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, candidate_id ORDER BY created_at DESC, id DESC) AS rn FROM sub WHERE match_result IN ('matched','matched_harmonic')) WHERE rn=1)"


def latest_matches(t):
    return latest(t.submissions().filter(F.col("match_result").isin("matched", "matched_harmonic")), ["user_id", "candidate_id"], ["created_at", "id"])


@query("jn20_own_discoveries", "SELECT user_id, candidate_id, id, judgment, disposition FROM latest JOIN disp USING (candidate_id) WHERE disposition<>'fp' AND (disposition='confirmed' OR judgment='LIKELY')", "sub disp", LATEST)
def _(t):
    x = latest_matches(t).join(t.dispositions(), "candidate_id")
    return x.filter("disposition <> 'fp' AND (disposition = 'confirmed' OR judgment = 'LIKELY')").select("user_id", "candidate_id", "id", "judgment", "disposition")


@query("jn21_public_discoveries",
       """SELECT star_id, count(*) AS discoveries, count(DISTINCT l.user_id) AS members, count(DISTINCT candidate_id) AS signals, count(*) FILTER (judgment='LIKELY') AS likely FROM latest l JOIN disp d USING (candidate_id) JOIN mem m ON m.user_id=l.user_id AND m.status='active' JOIN supplier s ON s.s_suppkey=l.candidate_id WHERE s_acctbal>=0 AND s_acctbal<9000 AND s_nationkey>=2 AND s_nationkey<22 GROUP BY star_id""", "sub disp mem", LATEST)
def _(t):
    from phasemill.operators.contracts import in_box
    box = in_box(t.supplier, "s_acctbal", "s_nationkey", (0, 9000, 2, 22)).select(F.col("s_suppkey").alias("candidate_id"))
    x = latest_matches(t).join(t.dispositions(), "candidate_id").join(box, "candidate_id", "left_semi").join(t.members().filter("status = 'active'"), "user_id", "left_semi")
    return x.groupBy("star_id").agg(F.count(F.lit(1)).alias("discoveries"), F.count_distinct("user_id").alias("members"), F.count_distinct("candidate_id").alias("signals"), F.count_if(F.col("judgment") == "LIKELY").alias("likely"))


@query("jn22_progress_checklist",
       """, items AS (SELECT * FROM (VALUES ('click',1),('error',2),('purchase',3),('signup',4),('view',5)) v(item, ordinal)), p AS (SELECT user_id, event_type AS item, count(*) AS n, max(value) AS top FROM events GROUP BY ALL)
       SELECT u.user_id, i.item, i.ordinal, CASE WHEN p.n IS NULL THEN 'locked' WHEN p.top>=120 THEN 'completed' WHEN p.n>=10 THEN 'in_progress' ELSE 'unlocked' END AS state FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN items i LEFT JOIN p USING (user_id, item)""", ctes="dummy AS (SELECT 1)")
def _(t):
    e = t.events.select("user_id", F.col("event_type").alias("item"), "value")
    p = e.groupBy("user_id", "item").agg(n(), F.max("value").alias("top"))
    items = F.posexplode(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])).alias("pos", "item")
    spine = p.select("user_id").distinct().select("user_id", items)
    state = F.when(F.col("n").isNull(), "locked").when(F.col("top") >= 120, "completed").when(F.col("n") >= 10, "in_progress").otherwise("unlocked")
    return spine.join(p, ["user_id", "item"], "left").select("user_id", "item", (F.col("pos") + 1).alias("ordinal"), state.alias("state"))


@query("jn23_reopened_without_activity",
       """SELECT r.user_id, r.ts AS reopened_at FROM (SELECT user_id, max(ts) AS ts FROM events WHERE event_type='error' GROUP BY 1) r WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id=r.user_id AND e.event_type='purchase' AND e.ts>r.ts)""")
def _(t):
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    x = t.events.groupBy("user_id").agg(at("error").alias("reopened_at"), at("purchase").alias("p"))
    return x.filter(F.col("reopened_at").isNotNull() & (F.col("p").isNull() | (F.col("p") <= F.col("reopened_at")))).select("user_id", "reopened_at")


@query("jn24_multi_exists_access",
       """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='F') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderpriority='1-URGENT')
       AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>480000) AND (SELECT count(*) FROM orders WHERE o_custkey=c_custkey AND o_orderpriority='2-HIGH')=1""")
def _(t):
    f = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("b"),
        F.bool_or(F.col("o_totalprice") > 480000).alias("c"), F.count_if(F.col("o_orderpriority") == "2-HIGH").alias("d"))
    return t.customer.select("c_custkey").join(f.filter("a and b and not c and d = 1"), "c_custkey", "left_semi")


@query("jn25_provenance_map_back",
       "SELECT series_id, count(*) FILTER (q=0 AND v<150) AS retained, count(*) FILTER (NOT (q=0 AND v<150)) AS rejected, CAST(sum(seq) FILTER (q=0 AND v<150) AS BIGINT) AS seq_sum FROM obs GROUP BY series_id", "obs")
def _(t):
    raw = t.obs()
    cleaned = cleaning.quality_filter(raw).filter("v < 150").select("series_id", "t")
    kept = raw.join(cleaned, ["series_id", "t"], "left_semi").groupBy("series_id").agg(F.count(F.lit(1)).alias("retained"), F.sum("seq").alias("seq_sum"))
    gone = raw.join(cleaned, ["series_id", "t"], "left_anti").groupBy("series_id").agg(F.count(F.lit(1)).alias("rejected"))
    return kept.join(gone, "series_id", "full_outer").fillna(0, ["retained", "rejected"])


@query("jn26_aligned_side_column",
       """, m AS (SELECT series_id, part_id, median(v) AS med FROM obs WHERE q=0 GROUP BY ALL)
       SELECT series_id, seq, round(v/med,8) AS nv, round((v*0.1+0.5)/med,8) AS nerr FROM obs JOIN m USING (series_id, part_id) WHERE q=0""", "obs", "dummy AS (SELECT 1)")
def _(t):
    x = cleaning.normalise_parts(cleaning.quality_filter(t.obs().withColumn("err", F.col("v") * 0.1 + 0.5)))
    return x.select("series_id", "seq", F.round("nv", 8).alias("nv"), F.round(F.col("err") / F.col("part_median"), 8).alias("nerr"))


@query("jn27_polymorphic_links",
       """SELECT e.event_id, e.event_type, CASE WHEN e.event_type IN ('view','click') THEN p.p_partkey ELSE s.s_suppkey END AS target_id, coalesce(CASE WHEN e.event_type IN ('view','click') THEN p.p_size>25 ELSE s.s_acctbal>0 END, false) AS available
       FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events) e LEFT JOIN part p ON e.event_type IN ('view','click') AND p.p_partkey=k AND p.p_size>25 LEFT JOIN supplier s ON e.event_type NOT IN ('view','click') AND s.s_suppkey=k AND s.s_acctbal>0""")
def _(t):
    e = t.events.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).withColumn("is_part", F.col("event_type").isin("view", "click"))
    targets = (t.part.filter("p_size > 25").select(F.col("p_partkey").alias("k"), F.lit(True).alias("is_part"))
               .unionByName(t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), F.lit(False).alias("is_part"))).withColumn("target_id", F.col("k")))
    return e.join(targets, ["k", "is_part"], "left").select("event_id", "event_type", "target_id", F.col("target_id").isNotNull().alias("available"))


@query("wn01_representative_row", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn=1")
def _(t):
    return latest(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"])


@query("wn02_first_and_last_rows",
       """SELECT user_id, candidate_id, arg_min(id, created_at) AS first_id, arg_min(match_result, created_at) AS first_result, arg_max(id, created_at) AS last_id, arg_max(match_result, created_at) AS last_result FROM sub GROUP BY ALL""", "sub")
def _(t):
    s = t.submissions()
    row, rank = F.struct("id", "match_result"), F.struct("created_at", "id")
    x = s.groupBy("user_id", "candidate_id").agg(F.min_by(row, rank).alias("f"), F.max_by(row, rank).alias("l"))
    return x.select("user_id", "candidate_id", F.col("f.id").alias("first_id"), F.col("f.match_result").alias("first_result"), F.col("l.id").alias("last_id"), F.col("l.match_result").alias("last_result"))


@query("wn04_next_sequence",
       """, old AS (SELECT o_custkey, count(*) AS m FROM orders WHERE o_orderdate<TIMESTAMP '2000-01-01' GROUP BY 1)
       SELECT o_orderkey, o_custkey, coalesce(m,0)+row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders LEFT JOIN old USING (o_custkey) WHERE o_orderdate>=TIMESTAMP '2000-01-01'""", ctes="dummy AS (SELECT 1)")
def _(t):
    cut = F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00"))
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    old = o.filter(F.col("o_orderdate") < cut).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("m"))
    batch = numbered(o.filter(F.col("o_orderdate") >= cut), "o_custkey", ["o_orderdate", "o_orderkey"], F.year("o_orderdate") * 12 + F.month("o_orderdate"), "rn")
    return batch.join(old, "o_custkey", "left").select("o_orderkey", "o_custkey", (F.coalesce("m", F.lit(0)) + F.col("rn")).alias("seq"))


@query("wn17_contiguous_watermark",
       "SELECT series_id, max(CASE WHEN part_id=rn-1 THEN part_id END) AS through FROM (SELECT series_id, part_id, row_number() OVER (PARTITION BY series_id ORDER BY part_id) AS rn FROM (SELECT DISTINCT series_id, part_id FROM obs WHERE v>60)) GROUP BY series_id", "obs")
def _(t):
    return rel.contiguous_watermark(t.obs().filter("v > 60"), "series_id", "part_id", 0)


@query("tk01_keyset_page", "SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate<TIMESTAMP '1999-06-01') OR (o_orderdate=TIMESTAMP '1999-06-01' AND o_orderkey>5000) ORDER BY o_orderdate DESC, o_orderkey LIMIT 51")
def _(t):
    x = rel.after_cursor(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", "1999-06-01 00:00:00", 5000)
    return rel.page(x, "o_orderdate", "o_orderkey", 50)


@query("tk02_top_groups", "SELECT author_id, count(*) AS n FROM posts WHERE status='visible' GROUP BY 1 ORDER BY n DESC, author_id LIMIT 5", "posts")
def _(t):
    return t.posts().filter("status = 'visible'").groupBy("author_id").agg(n()).orderBy(F.desc("n"), "author_id").limit(5)


@query("tk03_ranked_with_threshold",
       "SELECT candidate_id, count(DISTINCT user_id) AS participants, max(created_at) AS last_at FROM sub GROUP BY 1 HAVING count(DISTINCT user_id)>=10 ORDER BY participants DESC, last_at DESC, candidate_id DESC LIMIT 20", "sub")
def _(t):
    x = t.submissions().groupBy("candidate_id").agg(F.count_distinct("user_id").alias("participants"), F.max("created_at").alias("last_at"))
    return x.filter("participants >= 10").orderBy(F.desc("participants"), F.desc("last_at"), F.desc("candidate_id")).limit(20)


@query("tk07_seeded_pick", "SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY p_partkey)-1 AS rn, count(*) OVER () AS c FROM part WHERE p_size>25) WHERE rn=987654321%c")
def _(t):
    return rel.row_at(t.part.filter("p_size > 25").select("p_partkey", "p_name"), "p_partkey", 987654321, block=256)


@query("tk09_even_decimation",
       """, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t, seq)-1 AS r, count(*) OVER (PARTITION BY series_id) AS c FROM obs)
       SELECT series_id, seq FROM r WHERE c<=20 OR r IN (SELECT floor(i*(c-1)/19.0) FROM range(20) g(i))""", "obs", "dummy AS (SELECT 1)")
def _(t):
    return rel.decimate(t.obs(), ["series_id"], ["t", "seq"], F.floor(F.col("t") / 7.5), 20).select("series_id", "seq")


@query("tk10_child_page", """SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey FROM lineitem JOIN posts ON post_id=l_orderkey WHERE status='visible' AND l_linestatus='O' AND l_shipdate<TIMESTAMP '2000-01-01'
       ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey LIMIT 26""", "posts")
def _(t):
    parents = t.posts().filter("status = 'visible'").select(F.col("post_id").alias("l_orderkey"))
    kids = t.lineitem.filter((F.col("l_linestatus") == "O") & (F.col("l_shipdate") < F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00"))))
    x = kids.join(parents, "l_orderkey", "left_semi").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey")
    return x.orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_partkey").limit(26)


@query("so01_union_view", "SELECT user_id, candidate_id FROM sub WHERE match_result='matched' UNION ALL SELECT user_id, candidate_id FROM sub WHERE match_result='matched_harmonic' AND (user_id, candidate_id) NOT IN (SELECT (user_id, candidate_id) FROM sub WHERE match_result='matched')", "sub")
def _(t):
    s = t.submissions().select("user_id", "candidate_id", "match_result")
    first = s.filter("match_result = 'matched'").drop("match_result")
    more = s.filter("match_result = 'matched_harmonic'").drop("match_result").join(first, ["user_id", "candidate_id"], "left_anti")
    return first.unionByName(more)


def _contract_sql(name, table, key, bad, declared):
    return f"""SELECT '{name}' AS release, CAST({key} AS VARCHAR) AS id, 'parse' AS stage, 'bad_record' AS code, CAST(NULL AS VARCHAR) AS detail FROM {table} WHERE {bad}
UNION ALL SELECT '{name}', NULL, 'input', 'sequence_count_mismatch', concat('actual=', actual, ',expected=', expected, ',distinct=', uniq) FROM (SELECT count(*) AS actual, count(DISTINCT {key}) AS uniq FROM {table}) p, ({declared}) d WHERE NOT (actual = uniq AND uniq = expected)"""


def _contract_rows(name, records, key, bad, declared):
    """Error rows of a release, and one more if all parsed records, their distinct keys and the declared count differ."""
    errors = records.filter(bad).select(F.lit(name).alias("release"), F.col(key).cast("string").alias("id"), F.lit("parse").alias("stage"), F.lit("bad_record").alias("code"), F.lit(None).cast("string").alias("detail"))
    # Distinct keys are counted from one row per key, so no task holds a set of keys.
    parsed = records.groupBy(key).agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("actual"), F.count(key).alias("uniq")).withColumn("one", F.lit(1))
    facts = parsed.join(declared.withColumn("one", F.lit(1)), "one").filter(~((F.col("actual") == F.col("uniq")) & (F.col("uniq") == F.col("expected"))))
    detail = F.concat(F.lit("actual="), "actual", F.lit(",expected="), "expected", F.lit(",distinct="), "uniq")
    return errors.unionByName(facts.select(F.lit(name).alias("release"), F.lit(None).cast("string").alias("id"), F.lit("input").alias("stage"), F.lit("sequence_count_mismatch").alias("code"), detail.alias("detail")))


@query("so02_union_error_rows",
       _contract_sql("orders", "orders", "o_orderkey", "o_totalprice < 20000", "SELECT count(DISTINCT l_orderkey) AS expected FROM lineitem") + " UNION ALL "
       + _contract_sql("documents", "documents", "doc_id", "n_chars < 50", "SELECT count(*) AS expected FROM labels"))
def _(t):
    """The declared counts come from other tables: the orders that have lines, and the documents that have labels."""
    lines = t.lineitem.select("l_orderkey").distinct().agg(F.count("l_orderkey").alias("expected"))
    labels = t.labels.agg(F.count(F.lit(1)).alias("expected"))
    return _contract_rows("orders", t.orders, "o_orderkey", "o_totalprice < 20000", lines).unionByName(_contract_rows("documents", t.documents, "doc_id", "n_chars < 50", labels))


@query("so03_key_subtract", "SELECT user_id AS k FROM events EXCEPT SELECT l_suppkey FROM lineitem")
def _(t):
    return t.events.select(F.col("user_id").alias("k")).distinct().subtract(t.lineitem.select(F.col("l_suppkey").alias("k")))


@query("so04_two_way_difference", "(SELECT doc_id, 'only_documents' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL (SELECT doc_id, 'only_labels' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))")
def _(t):
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    return a.exceptAll(b).withColumn("side", F.lit("only_documents")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_labels")))


@query("so05_distinct_keys", "SELECT count(*) AS n, count(DISTINCT (user_id, ts)) AS d, count(*)=count(DISTINCT (user_id, ts)) AS unique_keys FROM events")
def _(t):
    per = t.events.groupBy("user_id", "ts").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d")).withColumn("unique_keys", F.col("n") == F.col("d"))
