"""Filters, predicates and contracts."""

from pyspark.sql import functions as F

from phasemill.functions.scalars import slug
from phasemill.operators import cleaning, contracts
from phasemill.plans.registry import query

EVENT_TYPES = ["signup", "view", "error", "purchase", "click"]


@query("fil02_quality_bitmask", "SELECT l_suppkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem WHERE l_linenumber & 2 = 0 GROUP BY l_suppkey")
def _(t):
    return contracts_lines(cleaning.bitmask_filter(t.lineitem, "l_linenumber", 2))


def contracts_lines(df):
    return df.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


MASKS = """masks AS (SELECT series_id, part_id, seq AS interval_id, t-0.2 AS lo, t+0.2 AS hi,
  CASE seq%4 WHEN 0 THEN 'both' WHEN 1 THEN 'left' WHEN 2 THEN 'right' ELSE 'neither' END AS closed FROM obs WHERE q=1)"""


def error_masks(t):
    closed = F.element_at(F.array(*[F.lit(x) for x in ("both", "left", "right", "neither")]), (F.col("seq") % 4 + 1).cast("int"))
    return t.obs().filter("q = 1").select("series_id", "part_id", F.col("seq").alias("interval_id"), (F.col("t") - 0.2).alias("lo"),
                                          (F.col("t") + 0.2).alias("hi"), closed.alias("closed"))


@query("fil03_interval_mask",
       """SELECT o.series_id, o.seq, string_agg(CAST(interval_id AS VARCHAR), ',' ORDER BY interval_id) AS hits FROM obs o JOIN masks m ON o.series_id=m.series_id AND o.part_id=m.part_id
       AND CASE closed WHEN 'both' THEN t>=lo AND t<=hi WHEN 'left' THEN t>=lo AND t<hi WHEN 'right' THEN t>lo AND t<=hi ELSE t>lo AND t<hi END GROUP BY o.series_id, o.seq""", "obs", MASKS)
def _(t):
    hits = cleaning.interval_hits(t.obs(), error_masks(t), "t", 0.5)
    return hits.select("series_id", "seq", F.concat_ws(",", F.col("hits").cast("array<string>")).alias("hits"))


@query("fil04_required_columns", "SELECT source, 'checksum,quality' AS missing, count(*) AS n_rows FROM documents GROUP BY 1")
def _(t):
    gone = contracts.missing_columns(t.documents, ["doc_id", "text", "quality", "checksum", "source"])
    return t.documents.groupBy("source").agg(F.lit(",".join(gone)).alias("missing"), F.count(F.lit(1)).alias("n_rows"))


@query("fil05_required_null_contract",
       """SELECT count(*) AS n_rows, count(*) FILTER (event_id IS NULL OR ts IS NULL OR user_id IS NULL OR value IS NULL) AS n_bad, '' AS missing FROM events""")
def _(t):
    need = ["event_id", "ts", "user_id", "value"]
    gone = contracts.missing_columns(t.events, need)
    return t.events.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(contracts.any_null(need)).alias("n_bad"), F.lit(",".join(gone)).alias("missing"))


@query("fil06_key_contract",
       """SELECT (SELECT count(*) FROM lineitem) AS n_rows, count(*) AS n_keys, CAST(coalesce(sum(n) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL),0) AS BIGINT) AS n_null_key,
       count(*) FILTER (n>1) AS n_duplicate_keys, CAST(sum(neq) AS BIGINT) AS n_unequal, min(lo)=max(hi) AS is_constant
       FROM (SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (l_orderkey IS DISTINCT FROM l_partkey) AS neq, min(l_linestatus) AS lo, max(l_linestatus) AS hi FROM lineitem GROUP BY ALL)""")
def _(t):
    return contracts.key_contract(t.lineitem, ["l_orderkey", "l_linenumber"], constant="l_linestatus", equal=("l_orderkey", "l_partkey"))


@query("fil07_one_pass_contract",
       """SELECT count(*) AS n_rows, count(*) FILTER (event_type NOT IN ('signup','view','error','purchase','click')) AS n_bad_type,
       count(*) FILTER (json_extract_string(props,'$.k') IS NULL) AS n_bad_props, count(*) FILTER (NOT isfinite(value) OR value<0) AS n_bad_value,
       (SELECT string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) FROM (SELECT DISTINCT part_id AS p FROM obs)) AS parts FROM events""", "obs")
def _(t):
    e = t.events.select("event_type", "props", "value", (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 86400000000.0 - 19723.0).alias("t"))
    return e.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("event_type").isin(EVENT_TYPES)).alias("n_bad_type"),
                 F.count_if(F.get_json_object("props", "$.k").isNull()).alias("n_bad_props"),
                 F.count_if(~cleaning.finite("value") | (F.col("value") < 0)).alias("n_bad_value"),
                 F.concat_ws(",", F.sort_array(F.collect_set(F.floor(F.col("t") / 7.5))).cast("array<string>")).alias("parts"))


@query("fil08_array_contract",
       """SELECT label, count(*) AS n, count(*) FILTER (len(embedding)=64 AND len(list_filter(embedding, lambda x: NOT isfinite(x)))=0) AS n_valid, count(*) FILTER (len(list_filter(embedding, lambda x: x<0))=0) AS n_nonnegative FROM embeddings GROUP BY label""")
def _(t):
    ok = (F.size("embedding") == 64) & F.forall("embedding", lambda x: cleaning.finite(x))
    return t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_valid"),
                                             F.count_if(F.forall("embedding", lambda x: x >= 0)).alias("n_nonnegative"))


@query("fil09_exclusion_ledger",
       """, r AS (SELECT series_id, part_id, seq, t, v, q, concat_ws(',', CASE WHEN q<>0 THEN 'quality_flag' END, CASE WHEN v>150 THEN 'value_limit' END, CASE WHEN part_id=2 THEN 'part_mask' END) AS reasons FROM obs)
       SELECT series_id, part_id, seq, round(t,8) AS t, v, q, reasons, n_raw - n_kept AS n_excluded FROM r JOIN (SELECT series_id, count(*) AS n_raw, count(*) FILTER (reasons='') AS n_kept FROM r GROUP BY ALL) USING (series_id) WHERE reasons<>''""", "obs", "dummy AS (SELECT 1)")
def _(t):
    x = t.obs().withColumn("reasons", contracts.all_reasons([
        ("quality_flag", F.col("q") != 0), ("value_limit", F.col("v") > 150), ("part_mask", F.col("part_id") == 2)]))
    sums = x.groupBy("series_id").agg((F.count(F.lit(1)) - F.count_if(F.size("reasons") == 0)).alias("n_excluded"))
    return x.filter(F.size("reasons") > 0).join(sums, "series_id").select(
        "series_id", "part_id", "seq", F.round("t", 8).alias("t"), "v", "q", F.concat_ws(",", "reasons").alias("reasons"), "n_excluded")


@query("fil10_nonfinite_encoding",
       """SELECT seq, CASE WHEN q=1 OR v>150 OR v<1 THEN NULL ELSE v END AS v, CASE WHEN q=1 THEN 'NaN' WHEN v>150 THEN '+Infinity' WHEN v<1 THEN '-Infinity' END AS spelling FROM obs""", "obs")
def _(t):
    odd = F.when(F.col("q") == 1, float("nan")).when(F.col("v") > 150, float("inf")).when(F.col("v") < 1, float("-inf")).otherwise(F.col("v"))
    value, text = contracts.spelled(F.col("odd"))
    return t.obs().withColumn("odd", odd).select("seq", value.alias("v"), text.alias("spelling"))


@query("fil11_text_search", "SELECT doc_id, lang, source FROM documents WHERE text ILIKE '%tion o%' AND lower(source)='src3' AND lang='en'")
def _(t):
    return contracts.text_search(t.documents, q="TION o", author="SRC3", board="EN").select("doc_id", "lang", "source")


@query("fil11_text_search_all_boards", "SELECT doc_id, lang FROM documents WHERE text ILIKE '%100\\%%' ESCAPE '\\' OR text ILIKE '%a\\_b%' ESCAPE '\\' OR text ILIKE '%license%'")
def _(t):
    a, b, c = (contracts.text_search(t.documents, q=q) for q in ("100%", "a_b", "license"))
    return a.unionByName(b).unionByName(c).select("doc_id", "lang").distinct()


@query("fil12_visible_publications", "SELECT post_id, author_id FROM posts JOIN mem ON mem.user_id=author_id WHERE posts.status='visible' AND mem.status='active'", "posts mem")
def _(t):
    return contracts.visible(t.posts(), t.members()).select("post_id", "author_id")


@query("fil13_history_filter",
       "SELECT id, user_id, candidate_id, match_result FROM sub WHERE match_result IN ('matched','matched_harmonic') AND created_at>=TIMESTAMP '2024-01-08' AND created_at<TIMESTAMP '2024-01-22'", "sub")
def _(t):
    return contracts.history(t.submissions(), results=["matched", "matched_harmonic"], start="2024-01-08 00:00:00", end="2024-01-22 00:00:00").select(
        "id", "user_id", "candidate_id", "match_result")


@query("fil14_bounding_box", "SELECT p_partkey, p_retailprice, p_size FROM part WHERE p_retailprice>=950 AND p_retailprice<1050 AND p_size>=10 AND p_size<40")
def _(t):
    return contracts.in_box(t.part, "p_retailprice", "p_size", (950, 1050, 10, 40)).select("p_partkey", "p_retailprice", "p_size")


@query("fil14_box_count", "SELECT count(*) AS n_in_box FROM part WHERE p_retailprice>=950 AND p_retailprice<1050 AND p_size>=10 AND p_size<40")
def _(t):
    return contracts.in_box(t.part, "p_retailprice", "p_size", (950, 1050, 10, 40)).agg(F.count(F.lit(1)).alias("n_in_box"))


@query("fil14_box_page", "SELECT p_partkey, p_retailprice, p_size FROM part WHERE p_retailprice>=950 AND p_retailprice<1050 AND p_size>=10 AND p_size<40 AND p_partkey>600 ORDER BY p_partkey LIMIT 101")
def _(t):
    box = contracts.in_box(t.part, "p_retailprice", "p_size", (950, 1050, 10, 40))
    return box.filter("p_partkey > 600").select("p_partkey", "p_retailprice", "p_size").orderBy("p_partkey").limit(101)


@query("fil15_status_per_entity",
       """SELECT series_id, CASE WHEN n_ok=0 THEN 'all_rejected' WHEN med_bad THEN 'invalid_normalization' WHEN n_ok<40 THEN 'insufficient_observations' ELSE 'ok' END AS code,
       n_ok>0 AND n_ok<40 AS retryable, 'kept ' || n_ok || ' of ' || n AS message FROM (SELECT series_id, count(*) AS n, count(*) FILTER (q=0) AS n_ok, coalesce(max(v) FILTER (q=0),0)<=0 AS med_bad FROM obs GROUP BY ALL)""", "obs")
def _(t):
    x = t.obs().groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("q") == 0).alias("n_ok"), F.max(F.when(F.col("q") == 0, F.col("v"))).alias("top"))
    code = contracts.first_reason([("all_rejected", F.col("n_ok") == 0), ("invalid_normalization", F.coalesce("top", F.lit(0.0)) <= 0),
                                   ("insufficient_observations", F.col("n_ok") < 40)])
    return x.select("series_id", F.coalesce(code, F.lit("ok")).alias("code"), ((F.col("n_ok") > 0) & (F.col("n_ok") < 40)).alias("retryable"),
                    F.format_string("kept %d of %d", "n_ok", "n").alias("message"))


@query("fil16_disjoint_audit_classes",
       """SELECT part_id, cls, n, CAST(sum(n) OVER (PARTITION BY part_id) AS BIGINT) AS n_part FROM (SELECT part_id, cls, count(*) AS n FROM (SELECT part_id, CASE WHEN q<>0 THEN 'quality' WHEN NOT isfinite(v) THEN 'non_finite' WHEN v<1 THEN 'non_positive' ELSE 'eligible' END AS cls FROM obs) GROUP BY ALL)""", "obs")
def _(t):
    cls = F.coalesce(contracts.first_reason([("quality", F.col("q") != 0), ("non_finite", ~cleaning.finite("v")), ("non_positive", F.col("v") < 1)]), F.lit("eligible"))
    x = t.obs().groupBy("part_id", cls.alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    return x.join(x.groupBy("part_id").agg(F.sum("n").alias("n_part")), "part_id")


REF = """ref AS (SELECT p_partkey AS ref_id, p_name, p_type, try_cast(substr(p_brand,7) AS DOUBLE) AS period, CASE WHEN p_size%7=0 THEN NULL ELSE p_size END AS duration FROM part)"""
REASON = "CASE WHEN p_type='PROMO' THEN 'unknown_target' WHEN p_type='LARGE' THEN 'not_transiting' WHEN period IS NULL OR duration IS NULL THEN 'missing_period_or_duration' WHEN NOT (period>0 AND duration/24.0<period) THEN 'invalid_geometry' END"


def references(t):
    x = t.part.select(F.col("p_partkey").alias("ref_id"), "p_name", "p_type", F.expr("try_cast(substr(p_brand, 7) AS double)").alias("period"),
                      F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("duration"))
    return x.withColumn("skip_reason", contracts.first_reason([
        ("unknown_target", F.col("p_type") == "PROMO"), ("not_transiting", F.col("p_type") == "LARGE"),
        ("missing_period_or_duration", F.col("period").isNull() | F.col("duration").isNull()),
        ("invalid_geometry", ~((F.col("period") > 0) & (F.col("duration") / 24.0 < F.col("period"))))]))


@query("fil17_reference_candidates", f"SELECT 'k' || ref_id || '-pc-' || trim(regexp_replace(lower(p_name),'[^a-z0-9]+','-','g'),'-') AS candidate, period, duration FROM ref WHERE {REASON} IS NULL", ctes=REF)
def _(t):
    return references(t).filter("skip_reason IS NULL").select(F.concat(F.lit("k"), "ref_id", F.lit("-pc-"), slug(F.col("p_name"))).alias("candidate"), "period", "duration")


@query("fil17_skipped_references", f"SELECT * FROM (SELECT ref_id, {REASON} AS skip_reason FROM ref) WHERE skip_reason IS NOT NULL", ctes=REF)
def _(t):
    return references(t).filter("skip_reason IS NOT NULL").select("ref_id", "skip_reason")


@query("fil18_output_allow_list", "SELECT vec_id, label, len(embedding) AS n_values, len(list_filter(embedding, lambda x: NOT isfinite(x)))=0 AS all_finite FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", "label", F.size("embedding").cast("bigint").alias("n_values"), F.forall("embedding", lambda x: cleaning.finite(x)).alias("all_finite"))


@query("fil19_tile_snapping", "SELECT floor(p_retailprice/100.0)*100.0 AS x0, floor(p_size/8.0)*8.0 AS y0, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY ALL")
def _(t):
    x = t.part.select(contracts.tile("p_retailprice", 100.0).cast("double").alias("x0"), contracts.tile("p_size", 8.0).cast("double").alias("y0"), "p_partkey")
    return x.groupBy("x0", "y0").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_id"))
