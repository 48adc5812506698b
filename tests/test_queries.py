"""Registered queries against their SQL, one or more per section, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows

SF = "/root/testdata/sf0.001"
NAMES = [
    "fil03_interval_mask", "fil09_exclusion_ledger", "fil16_disjoint_audit_classes", "ts01_part_median_normalise", "ts04_grid_summary",
    "ts09_folded_median_snapshot", "wn05_gap_segments", "wn07_observed_runs", "wn09_biweight_trend", "wn13_quadratic_trend", "ts16_box_search",
    "tk05_cell_and_harmonic_peaks", "ts13_model_removal", "ts24_window_offset", "ts28_parity_and_secondary_depth", "jn08_ephemeris_match",
    "jn13_interval_overlap", "jn18_follow_feed", "id03_reconcile", "id12_match_decision", "id13_injection_match", "ag06_kpi_table", "ag06_kpi_report", "ag09_member_metrics", "ag10_cohort_medians",
    "ag30_average_precision", "ag34_medians_by_class", "tk07_seeded_pick", "so03_key_subtract", "hx03_record_set_checksum", "hx05_hash_bucket",
    "inc07_bundle_assembly", "inc14_status_history", "src04_csv_with_preamble", "src11_source_list_parse", "st01_outbox_deduplication", "st09_session_activity",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_callable():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows(cols, cur.fetchall())


def test_registry_without_the_training_data_part(tmp_path):
    """A copy without the optional folders imports and lists the other queries, with or without the pipeline file."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(root / "phasemill", tmp_path / "phasemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, m = map(int, out.stdout.split())
    assert n >= 263 and m >= 255
