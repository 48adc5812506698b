"""Hashes, JSON, text and time scalars."""

from pyspark.sql import functions as F

from phasemill.functions import hashing, scalars
from phasemill.operators.ordered import numbered
from phasemill.plans.registry import query, set_digest_sql


@query("hx01_canonical_json_hash",
       """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS digest FROM customer""")
def _(t):
    return t.customer.select("c_custkey", hashing.content_hash(["c_name", "c_custkey", "c_nationkey", "c_mktsegment"]).alias("digest"))


@query("hx02_array_checksum")
def _(t):
    return t.embeddings.select("vec_id", hashing.array_checksum(F.col("embedding")).alias("checksum"))


@query("hx03_record_set_checksum", "SELECT c_nationkey, count(*) AS n_rows, " + set_digest_sql("""'{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}'""") + " AS digest FROM customer GROUP BY 1")
def _(t):
    return hashing.record_set_digest(t.customer, ["c_nationkey"], ["c_custkey", "c_mktsegment"])


@query("hx04_version_digest",
       """SELECT series_id, 'pv1-' || sha256(string_agg(l, chr(10) ORDER BY l) || chr(10)) AS version FROM (SELECT series_id, 'segment:' || series_id || ':' || part_id || ':' || count(*) AS l FROM obs GROUP BY series_id, part_id) GROUP BY series_id""", "obs")
def _(t):
    lines = t.obs().groupBy("series_id", "part_id").agg(F.count(F.lit(1)).alias("n")).select(
        "series_id", F.concat_ws(":", F.lit("segment"), "series_id", "part_id", "n").alias("line"))
    text = F.concat(F.concat_ws("\n", F.sort_array(F.collect_list("line"))), F.lit("\n"))
    return lines.groupBy("series_id").agg(F.concat(F.lit("pv1-"), F.sha2(text, 256)).alias("version"))


@query("hx05_hash_bucket", "SELECT p_partkey, CAST(CAST('0x' || substr(sha256(p_name || p_partkey),1,16) AS UBIGINT) % 13 AS BIGINT) AS bucket, p_partkey % 7 AS id_bucket FROM part")
def _(t):
    return t.part.select("p_partkey", hashing.hash_bucket(F.concat("p_name", "p_partkey"), 13).alias("bucket"), F.pmod("p_partkey", F.lit(7)).alias("id_bucket"))


@query("hx06_ordered_stream_hash", "SELECT count(*) AS n_rows, " + set_digest_sql("""'{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || '}'""") + " AS digest FROM orders")
def _(t):
    # Each row carries its sort key, so the set of rows fixes the sorted stream.
    return hashing.record_set_digest(t.orders, [], ["o_custkey", "o_orderkey"])


@query("hx07_json_path", "SELECT event_id, json_extract_string(props,'$.k') AS k, json_extract_string(props,'$.missing.deep') AS gone FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing.deep").alias("gone"))


EVID = """ev AS (SELECT event_id, user_id, CASE event_id%4 WHEN 0 THEN '["oddeven","ushape"]' WHEN 1 THEN '["secondary","oddeven","oddeven"]' WHEN 2 THEN '{"x":1}' END AS checks FROM events)"""


def evidence(t):
    m = F.col("event_id") % 4
    return t.events.select("event_id", "user_id", "value", F.when(m == 0, '["oddeven","ushape"]').when(m == 1, '["secondary","oddeven","oddeven"]').when(m == 2, '{"x":1}').alias("checks"))


@query("hx08_json_array_explode", "SELECT event_id, unnest(CAST(checks AS VARCHAR[])) AS element FROM ev WHERE checks LIKE '[%'",
       ctes=EVID.replace("'[\"oddeven\",\"ushape\"]'", "'[oddeven, ushape]'").replace("'[\"secondary\",\"oddeven\",\"oddeven\"]'", "'[secondary, oddeven, oddeven]'"))
def _(t):
    return evidence(t).select("event_id", F.explode(scalars.json_strings(F.col("checks"))).alias("element"))


@query("hx09_json_build", """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS ordinal, '{"line":' || l_linenumber || ',"part":' || l_partkey || '}' AS payload FROM lineitem""")
def _(t):
    # One object per line, numbered within its order: no list grows with an order.
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    x = numbered(rows, "l_orderkey", ["l_linenumber", "l_partkey"], F.floor(F.col("l_linenumber") / 1000), "ordinal")
    return x.select("l_orderkey", "ordinal", F.to_json(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))).alias("payload"))


@query("hx10_local_time_buckets", """SELECT CAST(d AS VARCHAR) AS local_date, CAST(CAST(date_trunc('week', d) AS DATE) AS VARCHAR) AS week_start, count(*) AS n FROM (SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS d FROM events) GROUP BY ALL""")
def _(t):
    return t.events.groupBy(scalars.local_date(F.col("ts")).cast("string").alias("local_date"), scalars.local_week(F.col("ts")).cast("string").alias("week_start")).agg(F.count(F.lit(1)).alias("n"))


@query("hx11_epoch_scales",
       """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN round(o_totalprice,6) WHEN 'F' THEN round(o_totalprice-2457000.0,6) END AS epoch, o_orderstatus NOT IN ('O','F') AS held FROM orders""")
def _(t):
    scale = F.when(F.col("o_orderstatus") == "O", "BTJD-TDB").when(F.col("o_orderstatus") == "F", "BJD-TDB").otherwise("HJD")
    epoch = scalars.to_btjd(F.col("o_totalprice"), scale)
    return t.orders.select("o_orderkey", F.round(epoch, 6).alias("epoch"), epoch.isNull().alias("held"))


@query("hx12_summary_text",
       """SELECT p_partkey, 'period ' || regexp_replace(regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(20,6)) AS VARCHAR),'0+$',''),'\\.$','') || ' d, size ' || coalesce(CAST(p_size AS VARCHAR),'undetermined') AS summary FROM part""")
def _(t):
    return t.part.select("p_partkey", F.concat(F.lit("period "), scalars.trimmed(F.col("p_retailprice")), F.lit(" d, size "), F.coalesce(F.col("p_size").cast("string"), F.lit("undetermined"))).alias("summary"))


@query("hx13_identifier_parse",
       r"""SELECT page_id, regexp_extract(url,'^https?://(?:www\.|m\.)?([^/:]+)',1) AS host, regexp_extract(url,'/([a-z]{2})/',1) AS lang, regexp_extract(url,'/([0-9]+)(?:[?#]|$)',1) AS ident,
       trim(regexp_replace(lower(url),'[^a-z0-9]+','-','g'),'-') AS slug FROM pages""")
def _(t):
    return t.pages.select("page_id", F.regexp_extract("url", r"^https?://(?:www\.|m\.)?([^/:]+)", 1).alias("host"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"),
                          F.regexp_extract("url", r"/([0-9]+)(?:[?#]|$)", 1).alias("ident"), scalars.slug(F.col("url")).alias("slug"))


@query("id17_deterministic_split",
       """SELECT user_id, CASE WHEN CAST('0x' || substr(sha256(CAST(user_id AS VARCHAR)),1,2) AS BIGINT)%2=0 THEN 'calibration' ELSE 'evaluation' END AS split, count(*) AS n, 1 AS n_splits FROM events GROUP BY ALL""")
def _(t):
    x = t.events.withColumn("split", F.when(scalars.hash_parity(F.col("user_id")) == 0, "calibration").otherwise("evaluation"))
    return x.groupBy("user_id").agg(F.first("split").alias("split"), F.count(F.lit(1)).alias("n"), F.count_distinct("split").cast("int").alias("n_splits"))
