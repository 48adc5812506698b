"""Scans, sources and sinks."""

from pyspark.sql import functions as F

from phasemill.operators.contracts import all_reasons
from phasemill.plans.registry import query
from phasemill.session import scratch_path
from phasemill.sources import ingest as src


def n(name="n"):
    return F.count(F.lit(1)).alias(name)


@query("src01_pinned_schema_scan", "SELECT user_id, count(*) AS n, round(sum(value),6) AS total FROM events GROUP BY 1")
def _(t):
    return src.pinned(t.spark, t.path("events"), src.EVENT_SCHEMA).groupBy("user_id").agg(n(), F.round(F.sum("value"), 6).alias("total"))


@query("src02_multi_path_snapshot", "SELECT event_type, count(*) AS n, CAST(round(sum(value)*100) AS BIGINT) AS cents FROM events GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "parts")
    t.events.withColumn("kind", F.col("event_type")).write.partitionBy("kind").parquet(path)
    # One path per kind of event, a handful, as the events themselves name them.
    kinds = sorted(k for (k,) in t.events.select("event_type").distinct().collect())
    snap = src.snapshot(t.spark, [f"{path}/kind={k}" for k in kinds], src.EVENT_SCHEMA)
    return snap.groupBy("event_type").agg(n(), F.round(F.sum("value") * 100).cast("bigint").alias("cents"))


@query("src03_manifest_contract", "SELECT c_custkey, c_name, c_mktsegment, 7 AS part, 'aa' AS source_sha FROM customer")
def _(t):
    path = scratch_path(t.spark, "manifest")
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment", F.lit(7).alias("part"), F.lit("aa").alias("source_sha"))
    src.json_lines(rows, f"{path}/json")
    return src.manifest_to_parquet(t.spark, f"{path}/json", f"{path}/parquet", rows.schema, "c_custkey", declared_rows=t.customer.count(), constants={"part": 7, "source_sha": "aa"})


@query("src04_csv_with_preamble", """SELECT CAST(p_partkey AS VARCHAR) AS ident, CASE WHEN p_size%10=0 THEN 'ragged' ELSE 'ok' END AS reason, CASE WHEN p_size%10<>0 THEN p_name || ', "' || p_size || '"' END AS name, CASE WHEN p_size%10<>0 THEN p_size END AS size FROM part WHERE p_size%13<>0""")
def _(t):
    path = scratch_path(t.spark, "csv")
    size = F.col("p_size").cast("string")
    quoted = F.concat(F.lit('"'), "p_name", F.lit(', ""'), size, F.lit('"""'))
    row = F.concat_ws(",", F.col("p_partkey").cast("string"), quoted, size)
    line = F.when(F.col("p_size") % 13 == 0, F.concat(F.lit("# "), "p_name")).when(F.col("p_size") % 10 == 0, F.concat(row, F.lit(",extra"))).otherwise(row)
    t.part.select(line.alias("value")).write.text(path)
    x = src.csv_with_preamble(t.spark.read.text(path).withColumn("ordinal", F.lit(0)), ["ident", "name", "size"])
    ok = F.col("reason").isNull()
    return x.select("ident", F.coalesce("reason", F.lit("ok")).alias("reason"), F.when(ok, F.col("name")).alias("name"), F.when(ok, F.expr("try_cast(size AS int)")).alias("size"))


@query("src04_export_inspection", """SELECT s_suppkey AS export, CASE WHEN s_suppkey%7=1 THEN '<html>' WHEN s_suppkey%7=2 THEN 'order|order|qty' WHEN s_suppkey%7=3 THEN 'order|qty' ELSE 'order|note, free|qty' END AS columns, CASE WHEN s_suppkey%7=5 THEN 0 ELSE coalesce(k,0) END AS row_count, s_suppkey%3+1 AS preamble_lines,
 CASE WHEN s_suppkey%7=1 THEN 'html_or_xml_response' WHEN s_suppkey%7=2 THEN 'invalid_csv_header' WHEN s_suppkey%7=3 THEN 'missing_columns:note, free' WHEN s_suppkey%7=4 AND coalesce(w,0)>0 THEN 'inconsistent_csv_width' WHEN s_suppkey%7=5 OR coalesce(k,0)=0 THEN 'empty_export' END AS reason
 FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS k, count(*) FILTER (l_quantity>=45) AS w FROM lineitem GROUP BY 1) ON l_suppkey=s_suppkey""")
def _(t):
    kind = F.col("s_suppkey") % 7
    s = t.supplier.select(F.col("s_suppkey").alias("export"))
    head = F.when(kind == 1, "<html>").when(kind == 2, "order,order,qty").when(kind == 3, "order,qty").otherwise('order,"note, free",qty')
    top = t.supplier.select(F.col("s_suppkey").alias("export"), F.lit(0).cast("bigint").alias("ordinal"), head.alias("value"))
    early = t.supplier.select(F.col("s_suppkey").alias("export"), F.explode(F.expr("sequence(-1 - cast(s_suppkey % 3 AS bigint), -1L)")).alias("ordinal"))
    early = early.withColumn("value", F.when(F.col("ordinal") % 2 == 0, "").otherwise("# exported, \"today"))
    row = F.concat_ws(",", F.col("l_orderkey").cast("string"), F.lit('"a, ""b"""'), F.col("l_quantity").cast("int").cast("string"))
    wide = (F.col("l_suppkey") % 7 == 4) & (F.col("l_quantity") >= 45)
    rows = t.lineitem.filter("l_suppkey % 7 <> 5").select(F.col("l_suppkey").alias("export"), (F.col("l_orderkey") * 10000 + F.col("l_linenumber") + 1).alias("ordinal"), F.when(wide, F.concat(row, F.lit(",x"))).otherwise(row).alias("value"))
    x = src.inspected_exports(top.unionByName(early).unionByName(rows.join(s, "export", "left_semi")), ["qty", "note, free"])
    return x.withColumn("columns", F.array_join("columns", "|"))


MAN = "man AS (SELECT CAST(page_id AS VARCHAR) AS key, octet_length(encode(html))+CASE WHEN page_id%7=0 THEN 1 ELSE 0 END AS size_bytes, CASE WHEN page_id%11=0 THEN 'bad' ELSE sha256(html) END AS sha256 FROM pages WHERE page_id%5<>0), v AS (SELECT CAST(page_id AS VARCHAR) AS key, octet_length(encode(html)) AS size, CASE WHEN m.key IS NULL THEN 'unknown_key' WHEN m.size_bytes<>octet_length(encode(html)) THEN 'size_mismatch' WHEN m.sha256<>sha256(html) THEN 'digest_mismatch' ELSE 'ok' END AS code FROM pages LEFT JOIN man m ON m.key=CAST(page_id AS VARCHAR))"


def verified(t):
    blobs = t.pages.select(F.col("page_id").cast("string").alias("key"), F.encode("html", "UTF-8").alias("content"))
    p = F.col("page_id")
    man = t.pages.filter(p % 5 != 0).select(p.cast("string").alias("key"), (F.octet_length("html") + F.when(p % 7 == 0, 1).otherwise(0)).cast("bigint").alias("size_bytes"),
                                            F.when(p % 11 == 0, "bad").otherwise(F.sha2("html", 256)).alias("sha256"))
    return src.verified_blobs(blobs, man)


@query("src05_verified_binary_ingest", "SELECT key, size, code FROM v", ctes=MAN)
def _(t):
    return verified(t).select("key", "size", "code")


@query("src06_quarantine_split", "SELECT 'data' AS side, 'ok' AS code, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM v WHERE code='ok' UNION ALL SELECT 'error', code, count(*), NULL FROM v WHERE code<>'ok' GROUP BY code UNION ALL SELECT 'error', 'count_mismatch', count(*), NULL FROM v HAVING count(*) FILTER (code='ok')<>count(*)", ctes=MAN)
def _(t):
    # The tagged rows are narrow; they are counted by code once and both sides read the counts.
    x = verified(t).groupBy("code").agg(n(), F.sum("size").alias("bytes"))
    data = x.filter("code = 'ok'").select(F.lit("data").alias("side"), "code", "n", "bytes")
    bad = x.filter("code <> 'ok'").select(F.lit("error").alias("side"), "code", "n", F.lit(None).cast("bigint").alias("bytes"))
    total = x.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("code") == "ok", F.col("n"))).alias("ok")).filter("n <> coalesce(ok, 0)")
    return data.unionByName(bad).unionByName(total.select(F.lit("error").alias("side"), F.lit("count_mismatch").alias("code"), "n", F.lit(None).cast("bigint").alias("bytes")))


@query("src07_immutable_sink", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "sink")
    src.immutable(t.lineitem.groupBy("l_suppkey").agg(n()), path, files=2)
    return t.spark.read.parquet(path)


@query("src08_write_then_reread", "SELECT count(*) AS computed, count(*) AS written, true AS contract_ok FROM orders")
def _(t):
    return src.written_and_checked(t.orders, scratch_path(t.spark, "checked"))


@query("src09_run_summary", "SELECT count(*) AS n_rows, count(*) FILTER (event_type='error') AS n_errors, count(DISTINCT user_id) AS n_entities, count(*) FILTER (event_type='error')=0 AS contract_ok FROM events")
def _(t):
    path = scratch_path(t.spark, "summary")
    x = t.events.agg(n("n_rows"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count_distinct("user_id").alias("n_entities"))
    src.json_lines(x.withColumn("contract_ok", F.col("n_errors") == 0), path)
    return t.spark.read.schema("n_rows bigint, n_errors bigint, n_entities bigint, contract_ok boolean").json(path)


@query("src09_terminal_markers", "SELECT part_id, 'data_contract' AS failure_type, 'scan' AS error_stage, CASE WHEN count(*) FILTER (v IS NULL)>0 THEN 'MISSING_VALUES' ELSE 'FLAGGED_ROWS' END AS error_code FROM obs GROUP BY 1 HAVING count(*) FILTER (v IS NULL)>0 OR 5*count(*) FILTER (q<>0)>count(*)", "obs", "dummy AS (SELECT 1)")
def _(t):
    path = scratch_path(t.spark, "runs")
    runs = t.obs().groupBy("part_id").agg(n("n_rows"), F.count_if(F.col("q") != 0).alias("n_flagged"), F.count_if(F.col("v").isNull()).alias("n_missing"))
    code = F.when(F.col("n_missing") > 0, "MISSING_VALUES").when(5 * F.col("n_flagged") > F.col("n_rows"), "FLAGGED_ROWS")
    src.close_runs(runs, path, ["part_id"], code=code, stage="scan")
    return t.spark.read.schema("part_id int, failure_type string, error_stage string, error_code string").json(f"{path}/_TERMINAL")


@query("src10_json_lines_sink", "SELECT o_orderkey AS id, o_custkey AS owner, o_orderstatus AS status FROM orders")
def _(t):
    path = scratch_path(t.spark, "docs")
    doc = t.orders.select(F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status")).alias("meta")).alias("bundle"))
    src.json_lines(doc, path)
    return t.spark.read.schema(doc.schema).json(path).select("bundle.id", "bundle.meta.owner", "bundle.meta.status")


@query("src11_source_list_parse", "SELECT CASE WHEN page_id%9=0 THEN '' ELSE 'page' END AS name, CASE WHEN page_id%9=0 THEN '' ELSE CAST(page_id AS VARCHAR) END AS ident, CASE WHEN page_id%9=0 THEN 'malformed' WHEN (SELECT count(*) FROM pages q WHERE q.url=p.url AND q.page_id%9<>0)>1 THEN 'duplicate' ELSE 'ok' END AS status FROM pages p")
def _(t):
    line = F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("wget "), "url")).otherwise(F.concat(F.lit("curl -o page-"), F.col("page_id").cast("string"), F.lit(".html "), "url"))
    return src.parsed_sources(t.pages.select(line.alias("value"))).select("name", "ident", "status")


@query("src12_canary_sample", "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE)=(SELECT min(CAST(ts AS DATE)) FROM events) ORDER BY 1 LIMIT 10) GROUP BY 1")
def _(t):
    x = t.events.select("user_id", F.to_date("ts").alias("bundle"))
    return src.first_bundle(x, "bundle", "user_id", 10).groupBy("user_id").agg(n())


@query("src13_latest_event_per_key", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


@query("src14_download_audit", "SELECT c_custkey AS file, CASE WHEN e.user_id IS NULL THEN 'not_attempted' WHEN st NOT IN ('view','click') THEN 'not_validated' WHEN ck<>c_custkey%10 THEN 'checksum_mismatch' ELSE 'ok' END AS reason FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS st, arg_max(CAST(json_extract_string(props,'$.k') AS BIGINT)%10, event_id) AS ck FROM events GROUP BY 1) e ON e.user_id=c_custkey")
def _(t):
    state = F.when(F.col("event_type").isin("view", "click"), "VALIDATED").otherwise("FAILED")
    log = t.events.select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), state.alias("state"), (F.get_json_object("props", "$.k").cast("bigint") % 10).alias("checksum"))
    return src.download_audit(t.customer.select(F.col("c_custkey").alias("file"), (F.col("c_custkey") % 10).alias("want")), log)


@query("src15_coverage_shard", """WITH e AS (SELECT part_id, series_id, sum(1) AS b FROM obs GROUP BY ALL), a AS (SELECT part_id, series_id, sum(1) AS b FROM obs WHERE v<250 AND q=0 GROUP BY ALL)
 SELECT part_id, count(*) FILTER (a_b IS NULL) AS missing, count(*) FILTER (e_b IS NULL) AS extra, CAST(coalesce(sum(e_b),0) AS BIGINT) AS expected_bytes, CAST(coalesce(sum(a_b),0) AS BIGINT) AS actual_bytes, count(*) FILTER (a_b IS NULL)=0 AND count(*) FILTER (e_b IS NULL)=0 AND coalesce(sum(e_b),0)=coalesce(sum(a_b),0) AS agrees
 FROM (SELECT coalesce(e.part_id,a.part_id) AS part_id, e.b AS e_b, a.b AS a_b FROM e FULL OUTER JOIN a ON e.part_id=a.part_id AND e.series_id=a.series_id) GROUP BY 1""".replace("WITH e AS", ", e AS", 1), "obs", "dummy AS (SELECT 1)")
def _(t):
    x = t.obs().withColumn("b", F.lit(1))
    return src.coverage(x, x.filter("v < 250 AND q = 0"), "part_id", "series_id", "b")


@query("ud01_record_map", r"""SELECT page_id, regexp_extract(html,'<title>(.*?)</title>',1) AS title, octet_length(encode(html)) AS bytes FROM pages""")
def _(t):
    return t.pages.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.octet_length("html").cast("bigint").alias("bytes"))


@query("ud02_entity_grouped_map", "SELECT series_id, part_id, count(*) AS n, round(sum(v*v),6) AS energy, max(v)-min(v) AS spread FROM obs GROUP BY ALL", "obs")
def _(t):
    # The grouped map of an entity as a plain aggregate: partial sums combine before the shuffle.
    x = t.obs().groupBy("series_id", "part_id").agg(n(), F.round(F.sum(F.col("v") * F.col("v")), 6).alias("energy"), (F.max("v") - F.min("v")).alias("spread"))
    return x


@query("ud03_fan_out_to_tables", "SELECT 'series' AS output, count(DISTINCT series_id) AS n FROM obs UNION ALL SELECT 'points', count(*) FROM obs WHERE q=0 UNION ALL SELECT 'excluded', count(*) FROM obs WHERE q<>0 UNION ALL SELECT 'parts', count(DISTINCT (series_id, part_id)) FROM obs", "obs")
def _(t):
    path = scratch_path(t.spark, "fanout")
    obs = t.obs()
    outs = {"series": obs.select("series_id").distinct(), "points": obs.filter("q = 0"), "excluded": obs.filter("q <> 0"), "parts": obs.select("series_id", "part_id").distinct()}
    back = None
    for name, df in outs.items():
        src.immutable(df, f"{path}/{name}")
        row = t.spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("output"), n())
        back = row if back is None else back.unionByName(row)
    return back


@query("ud04_row_level_validation", "SELECT doc_id, concat_ws(',', CASE WHEN length(text)<>n_chars THEN 'length' END, CASE WHEN lang NOT IN ('en','fr') THEN 'lang' END, CASE WHEN n_chars<200 THEN 'short' END) AS violations FROM documents")
def _(t):
    v = all_reasons([("length", F.length("text") != F.col("n_chars")), ("lang", ~F.col("lang").isin("en", "fr")), ("short", F.col("n_chars") < 200)])
    return t.documents.select("doc_id", F.concat_ws(",", v).alias("violations"))
