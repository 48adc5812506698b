"""Incremental runs, publication and change history."""

from pyspark.sql import functions as F

from phasemill.functions.hashing import content_hash, record_set_digest
from phasemill.operators import publish as pb
from phasemill.operators.ordered import latest, numbered
from phasemill.plans.registry import query, set_digest_sql

D = "dummy AS (SELECT 1)"


def n(name="n"):
    return F.count(F.lit(1)).alias(name)


@query("inc01_size_plan", "SELECT count(*) AS n_entities, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n)*120+count(*)*4096 AS BIGINT) AS estimated_bytes, sum(n)*120+count(*)*4096<=5000000 AS within_budget FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)")
def _(t):
    return pb.size_plan(t.lineitem, "l_suppkey", per_row=120, per_entity=4096, budget=5_000_000)


INP = "inp AS (SELECT c_custkey, sha256('{\"c_mktsegment\":\"' || c_mktsegment || '\",\"c_nationkey\":' || c_nationkey || '}') AS input_hash FROM customer), prev AS (SELECT c_custkey, CASE WHEN c_acctbal<500 THEN 'x' ELSE input_hash END AS input_hash, c_acctbal>2000 AS ok FROM customer JOIN inp USING (c_custkey))"


@query("inc03_pending_rows", "SELECT c_custkey, input_hash FROM inp WHERE NOT EXISTS (SELECT 1 FROM prev WHERE prev.c_custkey=inp.c_custkey AND prev.input_hash=inp.input_hash AND ok)", ctes=INP)
def _(t):
    x = t.customer.withColumn("input_hash", content_hash(["c_mktsegment", "c_nationkey"]))
    prev = x.select("c_custkey", F.when(F.col("c_acctbal") < 500, "x").otherwise(F.col("input_hash")).alias("input_hash"), (F.col("c_acctbal") > 2000).alias("ok"))
    return pb.pending(x.select("c_custkey", "input_hash"), prev, ["c_custkey"])


AB = "a AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_totalprice AS x FROM orders WHERE o_orderdate>=TIMESTAMP '1996-01-01'), b AS (SELECT o_orderkey AS k, CASE WHEN o_custkey%9=0 THEN 'X' ELSE o_orderstatus END AS st, CASE WHEN o_custkey%7=0 THEN o_totalprice*(1+1e-9::DOUBLE) WHEN o_custkey%5=0 THEN o_totalprice*(1+1e-14::DOUBLE) ELSE o_totalprice END AS x FROM orders WHERE o_orderdate<TIMESTAMP '2001-01-01')"


def two_runs(t):
    at = lambda s: F.to_timestamp_ntz(F.lit(s))
    o, c = t.orders, F.col("o_custkey")
    x = F.col("o_totalprice")
    a = o.filter(F.col("o_orderdate") >= at("1996-01-01 00:00:00")).select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st"), x.alias("x"))
    b = o.filter(F.col("o_orderdate") < at("2001-01-01 00:00:00")).select(
        F.col("o_orderkey").alias("k"), F.when(c % 9 == 0, "X").otherwise(F.col("o_orderstatus")).alias("st"),
        F.when(c % 7 == 0, x * (1 + 1e-9)).when(c % 5 == 0, x * (1 + 1e-14)).otherwise(x).alias("x"))
    return a, b


@query("inc04_result_parity", "SELECT coalesce(a.k,b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' WHEN a.st<>b.st OR abs(a.x-b.x)>1e-12*greatest(abs(a.x),abs(b.x)) THEN 'differs' ELSE 'equal' END AS verdict FROM a FULL OUTER JOIN b ON a.k=b.k", ctes=AB)
def _(t):
    return pb.compare_rows(*two_runs(t), ["k"], ["st"], ["x"], 1e-12).select("k", "verdict")


@query("inc20_run_equality", "SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN b.k IS NULL OR a.k IS NULL THEN 'key_set' WHEN a.st IS DISTINCT FROM b.st OR a.x IS DISTINCT FROM b.x THEN 'row' ELSE 'equal' END AS verdict FROM a FULL OUTER JOIN b ON a.k=b.k) GROUP BY 1", ctes=AB)
def _(t):
    a, b = two_runs(t)
    x = pb.compare_rows(a, b, ["k"], ["st", "x"], [], 0.0)
    v = F.when(F.col("verdict").isin("only_left", "only_right"), "key_set").when(F.col("verdict") == "differs", "row").otherwise("equal")
    return x.groupBy(v.alias("verdict")).agg(n())


STG = "sg AS (SELECT user_id, event_type AS stage, CASE WHEN max(value)>110 THEN 'failed' ELSE 'ok' END AS status, min(value)<2 AS retryable, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS rk FROM events GROUP BY 1, 2)"


def stages(t):
    return t.events.groupBy("user_id", F.col("event_type").alias("stage")).agg(F.when(F.max("value") > 110, "failed").otherwise("ok").alias("status"), (F.min("value") < 2).alias("retryable"))


ORDER = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


@query("inc05_entity_state", """, f AS (SELECT user_id, arg_min(stage, rk) FILTER (status='failed') AS fs, arg_min(retryable, rk) FILTER (status='failed') AS fr, count(*) FILTER (status='ok') AS ok FROM sg GROUP BY 1)
 SELECT user_id, CASE WHEN fs IS NULL AND ok>=5 THEN 'processed' WHEN fs IS NULL THEN 'unprocessed' WHEN fr THEN 'unprocessed' ELSE 'rejected' END AS state, fs AS failed_stage FROM f""", ctes=STG)
def _(t):
    return pb.current_state(stages(t), "user_id", ORDER)


@query("inc06_status_classification", """, s AS (SELECT user_id, count(*) FILTER (match_result='matched') AS m, count(*) FILTER (match_result='duplicate' AND value>100) AS q, count(DISTINCT candidate_id) FILTER (match_result IN ('matched','matched_harmonic')) AS d, min(value) FILTER (match_result='not_matched') AS lo FROM sub GROUP BY 1)
 SELECT c_custkey, CASE WHEN s.user_id IS NULL THEN 'unprocessed' WHEN q>2 THEN 'request_failed' WHEN m=0 THEN 'no_signal' WHEN d<20 THEN 'held' WHEN lo<0.5 THEN 'rejected' ELSE 'ready' END AS status, CASE WHEN s.user_id IS NULL THEN '' WHEN q>2 THEN 'external:source_held' WHEN m=0 THEN 'catalog:no_quality_peak' WHEN d<20 THEN 'discoverability:not_ready' WHEN lo<0.5 THEN 'malformed_input' ELSE '' END AS reasons FROM customer LEFT JOIN s ON s.user_id=c_custkey""", "sub", D)
def _(t):
    hit = F.col("match_result").isin("matched", "matched_harmonic")
    s = t.submissions().groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.count_if(F.col("match_result") == "matched").alias("m"), F.count_if((F.col("match_result") == "duplicate") & (F.col("value") > 100)).alias("q"),
        F.count_distinct(F.when(hit, F.col("candidate_id"))).alias("d"), F.min(F.when(F.col("match_result") == "not_matched", F.col("value"))).alias("lo"))
    x = t.customer.select("c_custkey").join(s, "c_custkey", "left")
    pick = lambda a: F.when(F.col("m").isNull(), a[0]).when(F.col("q") > 2, a[1]).when(F.col("m") == 0, a[2]).when(F.col("d") < 20, a[3]).when(F.col("lo") < 0.5, a[4]).otherwise(a[5])
    return x.select("c_custkey", pick(["unprocessed", "request_failed", "no_signal", "held", "rejected", "ready"]).alias("status"),
                    pick(["", "external:source_held", "catalog:no_quality_peak", "discoverability:not_ready", "malformed_input", ""]).alias("reasons"))


def bundle_heads(t):
    """One header per order, with the checks over all its lines that failed."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_linenumber").alias("steps"), n("n_rows"), F.max("l_linenumber").alias("top"))
    x = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus").join(lines, "o_orderkey", "left")
    bad = F.array_compact(F.array(F.when(F.col("n_rows").isNull(), "no_candidates"), F.when(F.col("steps") != F.col("n_rows"), "duplicate_step"), F.when(F.col("top") != F.col("steps"), "step_gap")))
    return x.withColumn("violations", F.concat_ws(",", bad))


def bundle_lines(t):
    """The lines of all orders."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("candidate_id"), F.col("l_quantity").alias("depth"))
    return lines.join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi")


@query("inc07_bundle_assembly", """SELECT o_orderkey, 0::BIGINT AS ordinal, '{"bundle":{"id":' || o_orderkey || ',"owner":' || o_custkey || ',"status":"' || o_orderstatus || '"}}' AS document, concat_ws(',', CASE WHEN nr IS NULL THEN 'no_candidates' END, CASE WHEN s<>nr THEN 'duplicate_step' END, CASE WHEN top<>s THEN 'step_gap' END) AS violations
 FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS s, count(*) AS nr, max(l_linenumber) AS top FROM lineitem GROUP BY ALL) ON l_orderkey=o_orderkey
 UNION ALL SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity), '{"step":' || l_linenumber || ',"candidate_id":' || l_partkey || ',"depth":' || l_quantity || '}', NULL FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")
def _(t):
    # A bundle is its header, numbered 0, and its children, numbered on: no document grows with its lines.
    head = F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"))
    heads = bundle_heads(t).select("o_orderkey", F.lit(0).cast("bigint").alias("ordinal"), F.to_json(F.struct(head.alias("bundle"))).alias("document"), "violations")
    lines = numbered(bundle_lines(t), "o_orderkey", ["step", "candidate_id", "depth"], F.floor(F.col("step") / 1000), "ordinal")
    return heads.unionByName(lines.select("o_orderkey", "ordinal", F.to_json(F.struct("step", "candidate_id", "depth")).alias("document"), F.lit(None).cast("string").alias("violations")))


@query("inc08_child_rows_with_lineage", "SELECT l_orderkey, l_linenumber, l_partkey, p_type AS source, CASE WHEN p_size>25 THEN 'match' ELSE 'absence' END AS evidence, o_orderpriority AS lineage FROM lineitem JOIN orders ON o_orderkey=l_orderkey LEFT JOIN part ON p_partkey=l_partkey WHERE l_linestatus='O'")
def _(t):
    kids = t.lineitem.filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    x = kids.join(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey").join(t.part.select("p_partkey", "p_type", "p_size"), "p_partkey", "left")
    return x.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("source"),
                    F.when(F.col("p_size") > 25, "match").otherwise("absence").alias("evidence"), F.col("o_orderpriority").alias("lineage"))


@query("inc09_part_metadata", "SELECT l_partkey, count(DISTINCT (l_discount, l_tax)) AS n_versions, count(DISTINCT (l_discount, l_tax))=1 AS agrees, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    v = t.lineitem.groupBy("l_partkey", "l_discount", "l_tax").agg(n("c"))
    return v.groupBy("l_partkey").agg(n("n_versions"), (F.count(F.lit(1)) == 1).alias("agrees"), F.sum("c").alias("n"))


@query("inc10_publish_gate", """WITH v AS (SELECT 'duplicate_child' AS rule, l_orderkey || '/' || l_linenumber AS key FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*)>3 UNION ALL SELECT 'missing_children', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
 UNION ALL SELECT 'orphan_child', CAST(l_orderkey AS VARCHAR) FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)),
 r AS (SELECT z.rule, count(key) AS n, min(key) AS k FROM (VALUES ('duplicate_child'),('missing_children'),('orphan_child')) z(rule) LEFT JOIN v ON v.rule=z.rule GROUP BY 1)
 SELECT coalesce(rule,'all') AS rule, CAST(sum(n) AS BIGINT) AS n_violations, min(k) AS first_key, CASE WHEN sum(n)>0 THEN 'hold' ELSE 'publish' END AS verdict FROM r GROUP BY ROLLUP (rule)""")
def _(t):
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"))
    return pb.gate(pb.family_rules(orders, t.lineitem, "l_orderkey", "l_linenumber", 3))


BUNDLES = """WITH pl AS (SELECT l_orderkey, count(*) FILTER (l_linestatus='O') AS a FROM lineitem GROUP BY 1), ma AS (SELECT o_orderkey FROM orders WHERE o_orderkey%101<>0),
 ct AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey%83=0 AND l_linenumber=1 AND l_linestatus='O'),
 v AS (SELECT 'bundle_not_in_manifest' AS rule, l_orderkey AS key FROM pl WHERE l_orderkey NOT IN (SELECT o_orderkey FROM ma) UNION ALL SELECT 'bundle_missing', o_orderkey FROM ma WHERE o_orderkey NOT IN (SELECT l_orderkey FROM pl)
 UNION ALL SELECT 'checksum_mismatch', l_orderkey FROM pl JOIN ma ON o_orderkey=l_orderkey WHERE l_orderkey%97=0 UNION ALL SELECT 'candidate_counts_differ', l_orderkey FROM pl JOIN ma ON o_orderkey=l_orderkey WHERE l_orderkey%89=0 UNION ALL SELECT 'candidate_table_differs', l_orderkey FROM ct),
 r AS (SELECT z.rule, count(key) AS n, min(CAST(key AS VARCHAR)) AS k FROM (VALUES ('bundle_not_in_manifest'),('bundle_missing'),('checksum_mismatch'),('candidate_counts_differ'),('candidate_table_differs')) z(rule) LEFT JOIN v ON v.rule=z.rule GROUP BY 1)
 SELECT coalesce(rule,'all') AS rule, CAST(sum(n) AS BIGINT) AS n_violations, min(k) AS first_key, CASE WHEN sum(n)>0 THEN 'hold' ELSE 'publish' END AS verdict FROM r GROUP BY ROLLUP (rule)"""


@query("inc10_bundle_gate", BUNDLES)
def _(t):
    # The manifest and the candidate table are made from the lines, with a fault planted in some entries.
    cols, key = ["l_linenumber", "l_linestatus", "l_partkey"], F.col("l_orderkey")
    lines = t.lineitem.select("l_orderkey", *cols)
    active = F.col("l_linestatus") == "O"
    made = record_set_digest(lines, ["l_orderkey"], cols, [F.count_if(active).alias("n_active"), F.count_if(~active).alias("n_retired")])
    entries = t.orders.filter("o_orderkey % 101 <> 0").select(F.col("o_orderkey").alias("l_orderkey")).join(made, "l_orderkey", "left")
    entries = entries.select("l_orderkey", F.when(key % 97 == 0, "changed").otherwise(F.coalesce("digest", F.lit("none"))).alias("digest"),
                             (F.coalesce("n_active", F.lit(0)) + F.when(key % 89 == 0, 1).otherwise(0)).alias("n_active"), F.coalesce("n_retired", F.lit(0)).alias("n_retired"))
    table = lines.filter(active & ~((key % 83 == 0) & (F.col("l_linenumber") == 1)))
    return pb.gate(pb.bundle_rules(lines, entries, table, key="l_orderkey", child="l_linenumber", cols=cols, active=active))


RUNS = """, tg AS (SELECT c_custkey%7 AS run_id, c_custkey AS target FROM customer WHERE c_custkey%50<>3), rs AS (SELECT series_id%7 AS run_id, series_id AS target, CASE WHEN count(*) FILTER (q=0)>=60 THEN 'ready' WHEN count(*) FILTER (q=0)>=50 THEN 'held' WHEN series_id%7=2 OR count(*) FILTER (q=0)>=48 THEN 'no_signal' ELSE 'request_failed' END AS status FROM obs WHERE series_id%7<>4 OR series_id%50<>3 GROUP BY series_id),
 j AS (SELECT coalesce(tg.run_id, rs.run_id) AS run_id, tg.target IS NOT NULL AS mine, coalesce(status,'unprocessed') AS status FROM tg FULL OUTER JOIN rs ON rs.target=tg.target), cd AS (SELECT DISTINCT user_id%7 AS run_id, user_id, candidate_id FROM sub JOIN rs ON target=user_id AND status='ready' WHERE match_result='matched'),
 a AS (SELECT run_id, count(*) FILTER (mine) AS n_targets, count(*) FILTER (mine AND status='ready') AS n_ready, count(*) FILTER (mine AND status='held') AS n_held, count(*) FILTER (mine AND status='no_signal') AS n_no_signal, count(*) FILTER (mine AND status='request_failed') AS n_request_failed, count(*) FILTER (mine AND status='unprocessed') AS n_unprocessed, count(*) FILTER (NOT mine) AS outside_targets FROM j GROUP BY 1),
 c AS (SELECT run_id, count(*) AS n_candidates, """ + set_digest_sql("""'{"candidate_id":' || candidate_id || ',"user_id":' || user_id || '}'""") + """ AS candidates_digest FROM cd GROUP BY 1)
 SELECT a.*, 0 AS repeated_results, coalesce(n_candidates,0) AS n_candidates, 0 AS repeated_candidates, candidates_digest, CASE WHEN outside_targets>0 THEN 'result_outside_targets' END AS reason, CASE WHEN outside_targets>0 THEN 'rejected' WHEN n_request_failed+n_unprocessed=0 THEN 'complete' ELSE 'incomplete' END AS status FROM a LEFT JOIN c USING (run_id)"""


@query("ag24_run_manifest", RUNS, "obs sub", "dummy AS (SELECT 1)")
def _(t):
    run = lambda c: (F.col(c) % 7).alias("run_id")
    targets = t.customer.filter("c_custkey % 50 <> 3").select(run("c_custkey"), F.col("c_custkey").alias("target"))
    ok = F.count_if(F.col("q") == 0)
    seen = t.obs().filter("series_id % 7 <> 4 OR series_id % 50 <> 3").groupBy("series_id").agg(ok.alias("ok"))
    status = F.when(F.col("ok") >= 60, "ready").when(F.col("ok") >= 50, "held").when((F.col("series_id") % 7 == 2) | (F.col("ok") >= 48), "no_signal").otherwise("request_failed")
    results = seen.select(run("series_id"), F.col("series_id").alias("target"), status.alias("status"))
    hits = t.submissions().filter("match_result = 'matched'").select("user_id", "candidate_id").distinct()
    ready = results.filter("status = 'ready'").select(F.col("target").alias("user_id"))
    cand = hits.join(ready, "user_id", "left_semi").select(run("user_id"), "user_id", "candidate_id", F.concat_ws("/", "user_id", "candidate_id").alias("cid"))
    return pb.roll_up(targets, results, cand, run="run_id", target="target", statuses=["ready", "held", "no_signal", "request_failed", "unprocessed"], candidate="cid", cols=["candidate_id", "user_id"])


OLDNEW = "old AS (SELECT c_custkey AS k, c_mktsegment AS seg, CASE WHEN c_acctbal>0 THEN c_acctbal END AS bal, CASE WHEN c_acctbal<1000 THEN 'inactive' ELSE 'active' END AS status FROM customer WHERE c_nationkey<20), new AS (SELECT c_custkey AS k, CASE WHEN c_acctbal>8000 THEN 'MACHINERY' ELSE c_mktsegment END AS seg, CASE WHEN c_acctbal<500 THEN 1.5 END AS bal FROM customer WHERE c_nationkey>=3)"


def old_new(t):
    c = t.customer
    b = F.col("c_acctbal")
    old = c.filter("c_nationkey < 20").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.when(b > 0, b).alias("bal"), F.when(b < 1000, "inactive").otherwise("active").alias("status"))
    new = c.filter("c_nationkey >= 3").select(F.col("c_custkey").alias("k"), F.when(b > 8000, "MACHINERY").otherwise(F.col("c_mktsegment")).alias("seg"), F.when(b < 500, 1.5).alias("bal"))
    return old, new


@query("inc11_snapshot_upsert", "SELECT coalesce(o.k,n.k) AS k, coalesce(n.seg,o.seg) AS seg, CAST(coalesce(n.bal,o.bal) AS DOUBLE) AS bal FROM old o FULL OUTER JOIN new n ON o.k=n.k", ctes=OLDNEW)
def _(t):
    return pb.upsert(*old_new(t), ["k"], ["seg", "bal"])


@query("inc12_current_version", "SELECT o_custkey, o_orderkey AS version, CASE WHEN o_orderkey=max(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'current' ELSE 'archived' END AS status FROM orders")
def _(t):
    return pb.switch_current(t.orders.select("o_custkey", F.col("o_orderkey").alias("version")), "o_custkey", "version")


@query("inc13_load_outcome", """, v AS (SELECT o_custkey AS k, o_orderkey AS ver, sha256(o_orderstatus) AS digest FROM orders), s AS (SELECT k, ver, CASE WHEN k%6=0 THEN 'other' ELSE digest END AS digest, CASE WHEN ver=max(ver) OVER (PARTITION BY k) THEN 'current' ELSE 'archived' END AS status FROM v WHERE ver<12000)
 SELECT v.k, v.ver, CASE WHEN s.digest IS NULL THEN 'PUBLISHED' WHEN s.digest<>v.digest THEN 'CONFLICT' WHEN s.status='current' THEN 'ALREADY_PUBLISHED' ELSE 'SUPERSEDED' END AS outcome FROM v LEFT JOIN s ON s.k=v.k AND s.ver=v.ver""", ctes=D)
def _(t):
    v = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ver"), F.sha2("o_orderstatus", 256).alias("digest"))
    s = pb.switch_current(v.filter("ver < 12000"), "k", "ver").withColumn("digest", F.when(F.col("k") % 6 == 0, "other").otherwise(F.col("digest")))
    return pb.load_outcome(v, s, ["k", "ver"]).select("k", "ver", "outcome")


@query("inc14_status_history", "SELECT k, field, old_value, new_value FROM (SELECT coalesce(o.k,n.k) AS k, 'seg' AS field, o.seg AS old_value, n.seg AS new_value FROM old o FULL OUTER JOIN new n ON o.k=n.k UNION ALL SELECT coalesce(o.k,n.k), 'low', CAST(o.bal<1000 AS VARCHAR), CAST(n.bal<1000 AS VARCHAR) FROM old o FULL OUTER JOIN new n ON o.k=n.k) WHERE old_value IS DISTINCT FROM new_value", ctes=OLDNEW)
def _(t):
    o, nw = (x.withColumn("low", F.col("bal") < 1000) for x in old_new(t))
    return pb.history_rows(o, nw, ["k"], ["seg", "low"])


@query("inc15_relabel_marks", ", m AS (SELECT user_id, candidate_id, arg_min(judgment, (created_at, id)) AS recognised, max(value)>150 AS marked FROM sub WHERE match_result='matched' GROUP BY ALL) SELECT user_id, candidate_id, recognised, disposition, CASE WHEN (recognised='LIKELY')<>(disposition='confirmed') AND NOT marked THEN 'set' WHEN (recognised='LIKELY')=(disposition='confirmed') AND marked THEN 'clear' END AS change FROM m JOIN disp USING (candidate_id) WHERE ((recognised='LIKELY')<>(disposition='confirmed'))<>marked", "sub disp", D)
def _(t):
    m = t.submissions().filter("match_result = 'matched'").groupBy("user_id", "candidate_id").agg(F.min_by("judgment", F.struct("created_at", "id")).alias("recognised"), (F.max("value") > 150).alias("marked"))
    x = m.join(t.dispositions(), "candidate_id").withColumn("differs", (F.col("recognised") == "LIKELY") != (F.col("disposition") == "confirmed"))
    return x.filter("differs <> marked").select("user_id", "candidate_id", "recognised", "disposition", F.when(F.col("differs"), "set").otherwise("clear").alias("change"))


@query("inc16_reopen_events", """, done AS (SELECT user_id, star_id FROM sub WHERE created_at<TIMESTAMP '2024-01-20' GROUP BY ALL HAVING count(*)>=3), fresh AS (SELECT user_id, star_id, count(DISTINCT candidate_id) AS new_signals FROM sub WHERE created_at>=TIMESTAMP '2024-01-20' AND match_result IN ('matched','matched_harmonic') GROUP BY ALL), sent AS (SELECT DISTINCT user_id, star_id FROM sub WHERE match_result='duplicate' AND value>100)
 SELECT user_id, star_id, new_signals FROM done JOIN fresh USING (user_id, star_id) WHERE (user_id, star_id) NOT IN (SELECT (user_id, star_id) FROM sent)""", "sub", D)
def _(t):
    cut = F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))
    late, hit = F.col("created_at") >= cut, F.col("match_result").isin("matched", "matched_harmonic")
    x = t.submissions().groupBy("user_id", "star_id").agg(F.count_if(~late).alias("before"), F.count_distinct(F.when(late & hit, F.col("candidate_id"))).alias("new_signals"),
                                                          F.bool_or((F.col("match_result") == "duplicate") & (F.col("value") > 100)).alias("sent"))
    return x.filter("before >= 3 AND new_signals > 0 AND NOT sent").select("user_id", "star_id", "new_signals")


SEGS = "seg AS (SELECT series_id, part_id, min(seq) AS child_id, sha256(CAST(count(*) AS VARCHAR)) AS checksum FROM obs WHERE v<200 GROUP BY ALL), inc AS (SELECT series_id, part_id, sha256(CAST(count(*) AS VARCHAR)) AS checksum FROM obs GROUP BY ALL)"


@query("inc17_segment_reuse", "SELECT i.series_id, i.part_id, CASE WHEN s.checksum IS NULL THEN 'insert' WHEN s.checksum=i.checksum THEN 'keep' ELSE 'conflict' END AS action, s.child_id AS kept_id FROM inc i LEFT JOIN seg s ON s.series_id=i.series_id AND s.part_id=i.part_id AND s.part_id<3", "obs", SEGS)
def _(t):
    g = lambda x: x.groupBy("series_id", "part_id").agg(F.min("seq").alias("child_id"), F.sha2(F.count(F.lit(1)).cast("string"), 256).alias("checksum"))
    return pb.reuse_children(g(t.obs().filter("v < 200")).filter("part_id < 3"), g(t.obs()).drop("child_id"), ["series_id", "part_id"])


@query("inc18_refresh_by_target", "SELECT k, seg FROM old WHERE k NOT IN (SELECT k FROM new WHERE bal IS NOT NULL) UNION ALL SELECT k, seg FROM new WHERE bal IS NOT NULL", ctes=OLDNEW)
def _(t):
    o, nw = old_new(t)
    return pb.refresh_targets(o.select("k", "seg"), nw.filter("bal IS NOT NULL").select("k", "seg"), "k")


@query("inc19_change_hash_upsert", "SELECT coalesce(o.k,n.k) AS k, coalesce(n.seg,o.seg) AS seg, CASE WHEN n.k IS NULL THEN 'inactive' ELSE 'active' END AS status, CASE WHEN o.k IS NULL OR (CASE WHEN n.k IS NULL THEN 'inactive' ELSE 'active' END)<>o.status OR (n.k IS NOT NULL AND n.seg<>o.seg) THEN 2 ELSE 1 END AS changed_at FROM old o FULL OUTER JOIN new n ON o.k=n.k", ctes=OLDNEW)
def _(t):
    o, nw = old_new(t)
    return pb.hash_upsert(o.withColumn("changed_at", F.lit(1)), nw, ["k"], ["seg"], F.lit(2))


@query("inc21_document_to_load_body", "SELECT l_orderkey, count(*) AS dispositions, count(*) FILTER (p_partkey IS NOT NULL AND p_size>25) AS refs, count(*) FILTER (p_partkey IS NULL OR p_size<=25) AS external_only, bool_or(l_returnflag='A') AS any_active, CASE WHEN bool_or(l_returnflag='A') THEN 'open' ELSE 'complete' END AS initial_status FROM lineitem LEFT JOIN part ON p_partkey=l_partkey GROUP BY 1")
def _(t):
    docs = bundle_lines(t).select(F.col("o_orderkey").alias("l_orderkey"), F.col("candidate_id").alias("p_partkey"))
    active = t.lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("any_active"))
    x = docs.join(t.part.select("p_partkey", "p_size"), "p_partkey", "left").groupBy("l_orderkey").agg(n("dispositions"), F.count_if(F.col("p_size") > 25).alias("refs"), F.count_if(F.col("p_size").isNull() | (F.col("p_size") <= 25)).alias("external_only"))
    return x.join(active, "l_orderkey").withColumn("initial_status", F.when(F.col("any_active"), "open").otherwise("complete"))


@query("inc22_anonymise_and_prune", "SELECT id, CASE WHEN status='withdrawn' THEN NULL ELSE s.user_id END AS user_id, match_result FROM sub s LEFT JOIN mem USING (user_id) WHERE NOT (coalesce(status,'')='withdrawn' AND match_result='duplicate')", "sub mem")
def _(t):
    gone = t.members().filter("status = 'withdrawn'")
    return pb.anonymise(t.submissions().select("id", "user_id", "match_result"), gone, "user_id", remove=F.col("match_result") == "duplicate")


@query("inc22_retention_prune", """SELECT 'receipt' AS kind, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'READY' ELSE 'PENDING' END AS status, NULL::BIGINT AS owner FROM orders WHERE NOT (o_orderstatus IN ('F','O') AND o_orderdate<TIMESTAMP '1998-01-01'-INTERVAL 90 DAY)
 UNION ALL SELECT 'post', post_id, CASE WHEN mem.status='withdrawn' AND created_at<TIMESTAMP '1998-01-01'-INTERVAL 365 DAY THEN 'deleted' ELSE posts.status END, CASE WHEN mem.status='withdrawn' THEN -1 ELSE author_id END FROM posts LEFT JOIN mem ON user_id=author_id""", "posts mem")
def _(t):
    now = F.expr("timestamp_ntz'1998-01-01 00:00:00'")
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "READY").otherwise("PENDING")
    receipts = t.orders.select(F.lit("receipt").alias("kind"), F.col("o_orderkey").alias("id"), state.alias("status"), F.lit(None).cast("bigint").alias("owner"), "o_orderdate")
    receipts = pb.prune(receipts, done=F.col("status").isin("READY", "COMPLETED"), since="o_orderdate", before=now - F.expr("INTERVAL 90 DAYS"))
    gone = t.members().filter("status = 'withdrawn'").select(F.col("user_id").alias("author_id"), F.lit(True).alias("gone")).distinct()
    posts = t.posts().select(F.lit("post").alias("kind"), F.col("post_id").alias("id"), "status", F.col("author_id").alias("owner"), "author_id", "created_at").join(gone, "author_id", "left")
    posts = pb.blanked(posts, due=F.col("gone"), values={"owner": F.lit(-1).cast("bigint")})
    posts = pb.blanked(posts, due=F.col("gone") & (F.col("created_at") < now - F.expr("INTERVAL 365 DAYS")), values={"status": F.lit("deleted")})
    cols = ["kind", "id", "status", "owner"]
    return receipts.select(cols).unionByName(posts.select(cols))
