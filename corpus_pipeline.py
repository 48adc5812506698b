"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet into the shared folder and rereads it as the next stage's documents, so a
lost executor never costs an earlier stage. All but the last return the columns of
``documents``. Null texts and empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasemill.llm import decontaminate, oddsketch, packing, quality, secrets
from phasemill.llm.common import stored

#: A document goes if it scores below this.
LEAST_QUALITY = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels of the folder, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # The row number ties each score to its row, also where ids repeat or are null.
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    rows = stored(rows, "pipeline-rows")
    stats = stored(quality.document_statistics(rows, doc_id="__row"), "quality-stats")
    named = stats.withColumnRenamed("doc_id", "__row").join(rows.select("__row", "doc_id"), "__row").select("doc_id", "stats")
    model = quality.fit(named, labels)
    bad = quality.score(stats, model).filter(F.col("score") < LEAST_QUALITY).select(F.col("doc_id").alias("__row"))
    return rows.join(bad, "__row", "left_anti").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, a null id last; texts without words stay."""
    # Decided by row, since ids repeat or are null; as a struct the key orders by id first.
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-near-rows")
    keyed = rows.withColumn("__key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))
    bad = oddsketch.near_duplicates(keyed, doc_id="__key").filter("not kept").select(F.col("doc_id.__row").alias("__row"))
    return rows.join(bad, "__row", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars renewed."""
    return secrets.redact(docs, secrets.fit(docs), length="n_chars")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of the permitted lengths."""
    return packing.pack(packing.counted(docs, length="__length"), "__length")


STAGES = [("quality_classifier", quality_filter), ("minhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination),
          ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: Neither the classifier nor the random field can be expressed in SQL; a test holds near_dedup against brute force,
#: the other stages and run() have no test of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
