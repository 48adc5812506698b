"""The registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES, ORACLES = {}, {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _register(name: str, module: str, *tables: str) -> None:
    operator = import_module(f"phasemill.llm.{module}")
    QUERIES[name] = lambda spark, folder: operator.query(*[_table(spark, folder, t) for t in tables])
    if hasattr(operator, "SQL"):
        ORACLES[name] = operator.SQL


for _entry in [
    ("op6_benchmark_decontamination", "decontaminate", "documents", "benchmark"),
    ("op7_quality_rules", "rules", "documents"),
    ("op8_quality_classifier", "quality", "documents", "labels"),
    ("op3_language_identification", "language", "documents"),
    ("op9_language_model_scores", "contexttree", "documents"),
    ("op10_secret_scans", "secrets", "documents"),
    ("op5_minhash_near_duplicates", "oddsketch", "documents"),
    ("op1_warc_round_trip", "warc", "pages"),
    ("op2_best_fit_packing", "packing", "documents"),
    ("op4_suffix_array_dedup", "suffix", "documents"),
    ("op11_periodic_runs", "periodic", "documents"),
    ("op12_document_fingerprints", "permutation", "documents"),
    ("op13_phrase_collocations", "collocations", "documents"),
]:
    _register(*_entry)
