"""The query registry: name -> (callable, equivalent SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasemill.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The input tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        tune(spark)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def obs(self) -> DataFrame:
        """Observations of one series per user: t in days, v, quality flag q."""
        us = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
        t = us / F.lit(86400000000.0) - F.lit(19723.0)
        return self.events.select(
            F.col("user_id").alias("series_id"), F.floor(t / 7.5).cast("int").alias("part_id"),
            F.col("event_id").alias("seq"), t.alias("t"), F.col("value").alias("v"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).alias("q"))

    def submissions(self) -> DataFrame:
        """One submission per event; the JSON path names the candidate."""
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.events.select(
            F.col("event_id").alias("id"), "user_id", k.alias("candidate_id"),
            F.floor(k / 5).cast("bigint").alias("star_id"), F.col("ts").alias("created_at"),
            F.when(F.col("event_type") == "purchase", "matched").when(F.col("event_type") == "signup", "matched_harmonic")
            .when(F.col("event_type") == "click", "not_matched").when(F.col("event_type") == "view", "ambiguous_match")
            .otherwise("duplicate").alias("match_result"),
            F.when(F.col("value") >= 60, "LIKELY").when(F.col("value") < 20, "UNLIKELY").otherwise("UNSURE").alias("judgment"),
            "value")

    def members(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias("user_id"), F.col("c_name").alias("nickname"),
            F.when(F.col("c_acctbal") < 0, "withdrawn").otherwise("active").alias("status"), "c_nationkey")

    def dispositions(self) -> DataFrame:
        """Truth label of each candidate, from the balance band of a supplier."""
        b = F.col("s_acctbal")
        disp = F.when(b < 2500, "confirmed").when(b < 5000, "fp").when(b < 7500, "pc").otherwise("none")
        return (self.supplier.select(F.col("s_suppkey").alias("candidate_id"), disp.alias("disposition"))
                .withColumn("answer_class", F.when(F.col("disposition").isin("confirmed", "fp"), "graded").otherwise("analysis"))
                .withColumn("truth", F.when(F.col("disposition") == "confirmed", "planet")
                            .when(F.col("disposition") == "fp", "not_planet")))

    def posts(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("author_id"), F.col("o_orderdate").alias("created_at"),
            F.when(F.col("o_orderstatus") == "P", "hidden").otherwise("visible").alias("status"),
            F.col("o_orderpriority").alias("board"), F.col("o_totalprice").alias("score"))


# The same views as SQL; each query's SQL names the ones it needs.
VIEWS = {
    "obs": """obs AS (SELECT user_id AS series_id,
        CAST(floor((CAST(epoch_us(ts) AS DOUBLE)/CAST(86400000000 AS DOUBLE) - 19723)/7.5) AS INTEGER) AS part_id,
        event_id AS seq, CAST(epoch_us(ts) AS DOUBLE)/CAST(86400000000 AS DOUBLE) - 19723 AS t, value AS v,
        CASE WHEN event_type='error' THEN 1 ELSE 0 END AS q FROM events)""",
    "sub": """sub AS (SELECT event_id AS id, user_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS candidate_id,
        CAST(floor(CAST(json_extract_string(props,'$.k') AS BIGINT)/5) AS BIGINT) AS star_id, ts AS created_at,
        CASE event_type WHEN 'purchase' THEN 'matched' WHEN 'signup' THEN 'matched_harmonic' WHEN 'click' THEN 'not_matched'
             WHEN 'view' THEN 'ambiguous_match' ELSE 'duplicate' END AS match_result,
        CASE WHEN value>=60 THEN 'LIKELY' WHEN value<20 THEN 'UNLIKELY' ELSE 'UNSURE' END AS judgment, value FROM events)""",
    "mem": """mem AS (SELECT c_custkey AS user_id, c_name AS nickname,
        CASE WHEN c_acctbal<0 THEN 'withdrawn' ELSE 'active' END AS status, c_nationkey FROM customer)""",
    "disp": """disp AS (SELECT candidate_id, disposition,
        CASE WHEN disposition IN ('confirmed','fp') THEN 'graded' ELSE 'analysis' END AS answer_class,
        CASE disposition WHEN 'confirmed' THEN 'planet' WHEN 'fp' THEN 'not_planet' END AS truth
        FROM (SELECT s_suppkey AS candidate_id, CASE WHEN s_acctbal<2500 THEN 'confirmed' WHEN s_acctbal<5000 THEN 'fp'
             WHEN s_acctbal<7500 THEN 'pc' ELSE 'none' END AS disposition FROM supplier))""",
    "posts": """posts AS (SELECT o_orderkey AS post_id, o_custkey AS author_id, o_orderdate AS created_at,
        CASE WHEN o_orderstatus='P' THEN 'hidden' ELSE 'visible' END AS status, o_orderpriority AS board,
        o_totalprice AS score FROM orders)""",
}


def set_digest_sql(line: str) -> str:
    """The digest of a record set as a DuckDB aggregate over row lines."""
    sums = ", ".join(f"CAST(sum(CAST('0x' || substr(sha256({line}), {1 + 12 * i}, 12) AS BIGINT)) AS VARCHAR)" for i in range(5))
    return f"sha256(concat_ws(':', count(*), {sums}))"


def query(name: str, sql: str | None = None, views: str = "", ctes: str = ""):
    """Register ``fn(tables) -> DataFrame``, with the SQL that must give the same rows."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            parts = [VIEWS[v] for v in views.split()] + ([ctes] if ctes else [])
            ORACLES[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql
        return fn

    return register
