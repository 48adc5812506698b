"""Sources, sinks, hashes and streams over several batches."""

import hashlib
import struct
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from phasemill.functions import hashing
from phasemill.operators import publish
from phasemill.operators.sizing import tasks_for
from phasemill.plans import load_all
from phasemill.plans.registry import QUERIES
from phasemill.session import scratch_path, shared_dir
from phasemill.sources import ingest
from phasemill.streaming import streams

SF = "/root/testdata/sf0.001"


def test_array_checksum_golden(spark):
    rows = [(1, [1.5, None, -0.0, 0.1]), (2, []), (3, None)]
    got = {r.i: r.c for r in spark.createDataFrame(rows, "i int, a array<double>").select("i", hashing.array_checksum(F.col("a")).alias("c")).collect()}
    raw = struct.pack("<f", 1.5) + bytes.fromhex("0000c07f") + struct.pack("<f", 0.0) + struct.pack("<f", 0.1)
    assert got == {1: "sha256:" + hashlib.sha256(raw).hexdigest(), 2: "sha256:" + hashlib.sha256(b"").hexdigest(), 3: None}
    bad = spark.createDataFrame([(1, [float("inf")])], "i int, a array<double>")
    with pytest.raises(Exception, match="non-finite"):
        bad.select(hashing.array_checksum(F.col("a"))).collect()


def test_record_digest_ignores_row_order(spark):
    df = spark.range(0, 500).selectExpr("id % 3 AS g", "id", "id * 7 AS v")
    d = lambda x: {r.g: r.digest for r in hashing.record_set_digest(x, ["g"], ["id", "v"]).collect()}
    assert d(df) == d(df.orderBy(F.desc("v")).repartition(7))
    assert d(df) != d(df.withColumn("v", F.col("v") + 1))
    assert d(df) != d(df.unionByName(df.filter("id = 3")))


def test_binary_files_against_a_manifest(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"abcd")
    (tmp_path / "c.bin").write_bytes(b"x")
    blobs = spark.read.format("binaryFile").load(str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("key"), "content")
    sha = hashlib.sha256(b"abc").hexdigest()
    man = spark.createDataFrame([("a.bin", 3, sha), ("b.bin", 3, sha)], "key string, size_bytes bigint, sha256 string")
    assert {r.key: r.code for r in ingest.verified_blobs(blobs, man).collect()} == {"a.bin": "ok", "b.bin": "size_mismatch", "c.bin": "unknown_key"}


def test_csv_preamble(spark):
    lines = ["﻿# exported", "", "id,name", "1,a", "2,b,c", "<html>"]
    x = ingest.csv_with_preamble(spark.createDataFrame(list(enumerate(lines)), "ordinal int, value string"), ["id", "name"])
    assert [(r.ordinal, r.reason, r.id) for r in x.orderBy("ordinal").collect()] == [(2, "header", "id"), (3, None, "1"), (4, "ragged", "2"), (5, "html", "<html>")]


def test_csv_keeps_quoted_commas(spark):
    lines = ['"id","name"', '1,"a, ""b"""', "2", '3,"c",']
    x = ingest.csv_with_preamble(spark.createDataFrame(list(enumerate(lines)), "ordinal int, value string"), ["id", "name"])
    assert [(r.reason, r.id, r.name) for r in x.orderBy("ordinal").collect()] == [("header", "id", "name"), (None, "1", 'a, "b"'), ("ragged", "2", None), ("ragged", "3", "c")]


def test_exports_are_inspected(spark):
    exports = {
        "ok": ["\ufeff# made today", "", 'a,"b, c",d', '1,"x, ""y""",2', "", "# 3,4,5"], "html": ["", " <html>", "a,b"], "names": ["a,b,a", "1,2,3"], "blank": ["a,,c", "1,2,3"], "one": ["a", "1"],
        "missing": ["a,d", "1,2"], "ragged": ['a,"b, c"', "1,2", "1,2,3"], "empty": ["# x", 'a,"b, c"', ""], "nothing": ["", "# only"]}
    rows = [(e, i, v) for e, lines in exports.items() for i, v in enumerate(lines)]
    got = {r.export: r for r in ingest.inspected_exports(spark.createDataFrame(rows, "export string, ordinal int, value string"), ["b, c", "a"]).collect()}
    assert {e: r.reason for e, r in got.items()} == {
        "ok": None, "html": "html_or_xml_response", "names": "invalid_csv_header", "blank": "invalid_csv_header", "one": "invalid_csv_header", "missing": "missing_columns:b, c",
        "ragged": "inconsistent_csv_width", "empty": "empty_export", "nothing": "invalid_csv_header"}
    assert (got["ok"].columns, got["ok"].row_count, got["ok"].preamble_lines) == (["a", "b, c", "d"], 2, 2)


def test_manifest_contract_names_every_broken_rule(spark):
    path = scratch_path(spark, "test")
    df = spark.createDataFrame([("a", 1, "s"), ("a", 2, "s"), ("b", None, "x")], "k string, v bigint, sha string")
    ingest.json_lines(df, f"{path}-json")
    with pytest.raises(ValueError, match="3 rows, declared 4; 1 rows with a null field; 1 rows of another sha; 1 duplicate keys"):
        ingest.manifest_to_parquet(spark, f"{path}-json", f"{path}-out", df.schema, "k", declared_rows=4, constants={"sha": "s"})


def test_bundles_are_held_against_manifest_and_candidates(spark):
    lines = spark.createDataFrame([(k, c, c < 3) for k in (1, 2, 3, 4) for c in (1, 2, 3)], "k int, c int, on boolean")
    entry = {r.k: r.digest for r in hashing.record_set_digest(lines, ["k"], ["c", "on"]).collect()}
    manifest = spark.createDataFrame([(1, entry[1], 2, 1), (2, "other", 2, 1), (3, entry[3], 1, 2), (5, "x", 0, 0)], "k int, digest string, n_active int, n_retired int")
    table = lines.filter("on AND NOT (k = 1 AND c = 2)").select("k", "c")
    rules = publish.bundle_rules(lines, manifest, table, key="k", child="c", cols=["c", "on"], active=F.col("on"))
    got = {r.rule: (r.n_violations, r.first_key, r.verdict) for r in publish.gate(rules).collect()}
    assert got == {"bundle_not_in_manifest": (1, "4", "hold"), "bundle_missing": (1, "5", "hold"), "checksum_mismatch": (1, "2", "hold"), "candidate_counts_differ": (1, "3", "hold"),
                   "candidate_table_differs": (1, "1", "hold"), "all": (5, "1", "hold")}


def test_family_rules_count_null_keys_copies_and_a_hot_parent(spark):
    kids = [(k, c) for k in (1, 2, 3, None) for c in (1, None)] + [(2, 7)] * 5 + [(None, 9)] * 4 + [(6, c) for c in range(500)] + [(8, 1)] * 4
    children = spark.createDataFrame(kids, "k bigint, c int")
    parents = spark.createDataFrame([(1,), (1,), (2,), (4,), (4,), (40,), (None,), (None,), (6,)], "k bigint")
    got = {r.rule: (r.n_violations, r.first_key, r.verdict) for r in publish.gate(publish.family_rules(parents, children, "k", "c", 3)).collect()}
    assert got == {"duplicate_child": (3, "2/7", "hold"), "missing_children": (5, "4", "hold"), "orphan_child": (3, "3", "hold"), "all": (11, "2/7", "hold")}
    none = publish.gate(publish.family_rules(parents.filter("k = 1"), children.filter("k = 1"), "k", "c", 3)).collect()
    assert {(r.rule, r.n_violations, r.first_key, r.verdict) for r in none} == {(x, 0, None, "publish") for x in ("duplicate_child", "missing_children", "orphan_child", "all")}


def test_publish_gate_counts_in_tasks_of_measured_size(spark):
    """No table of a whole split before the shuffle, and shuffles that are not merged by their packed size."""
    load_all()
    assert tasks_for(spark.range(5000), spark.range(3000), rows=20) == 400
    out = QUERIES["inc10_publish_gate"](spark, SF)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [plan[i + 1] for i, line in enumerate(plan) if "RepartitionByExpression [l_orderkey" in line and "l_linenumber" in line]
    assert below and not any("Aggregate" in line for line in below) and not any("LeftAnti" in line for line in plan)


def test_roll_up_accounts_for_every_target(spark):
    targets = spark.createDataFrame([(r, t) for r in (1, 2, 3, 4) for t in (1, 2)], "run int, t int")
    results = spark.createDataFrame([(1, 1, "ready"), (1, 2, "held"), (2, 1, "ready"), (3, 1, "ready"), (3, 2, "held"), (3, 9, "held"), (4, 1, "ready"), (4, 2, "ready")], "run int, t int, status string")
    cand = spark.createDataFrame([(1, "a"), (4, "b"), (4, "b")], "run int, cid string")
    rows = publish.roll_up(targets, results, cand, run="run", target="t", statuses=["ready", "held", "unprocessed"], candidate="cid", cols=["cid"]).collect()
    got = {r.run: (r.status, r.reason, r.n_targets, r.n_ready, r.n_unprocessed, r.n_candidates) for r in rows}
    assert got == {1: ("complete", None, 2, 1, 0, 1), 2: ("incomplete", None, 2, 1, 1, 0), 3: ("rejected", "result_outside_targets", 2, 1, 0, 0), 4: ("rejected", "duplicate_candidate_id", 2, 2, 0, 2)}


def test_sink_is_immutable_and_manifest_is_checked(spark):
    path = scratch_path(spark, "test")
    ingest.immutable(spark.range(5), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        ingest.immutable(spark.range(5), path)
    ingest.json_lines(spark.createDataFrame([(1,), (1,)], "k bigint"), f"{path}-json")
    with pytest.raises(ValueError, match="duplicate keys"):
        ingest.manifest_to_parquet(spark, f"{path}-json", f"{path}-out", spark.range(1).withColumnRenamed("id", "k").schema, "k")


@pytest.fixture(scope="module")
def batches(spark):
    """The events in time order, as four files."""
    path = scratch_path(spark, "batches")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(4):
        part = ev.filter(F.floor(F.dayofmonth("ts") / 8) == i).coalesce(1)
        part.write.parquet(f"{path}/events-{i}.parquet")
    flat = scratch_path(spark, "flat")
    for i in range(4):
        spark.read.parquet(f"{path}/events-{i}.parquet").coalesce(1).write.mode("append").parquet(flat)
    return flat


def stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def week():
    return F.floor(F.unix_seconds("ts") / 604800)


def test_sequences_have_no_gap_over_batches(spark, batches):
    out = streams.sequenced(stream(spark, batches).select("event_id", "user_id", "ts"), "seq", "user_id", ["ts", "event_id"], week).toPandas()
    assert len(out) == spark.read.parquet(batches).count()
    for _, g in out.groupby("user_id"):
        assert sorted(g.publication_seq) == list(range(1, len(g) + 1))


def test_changes_over_batches_equal_one_pass(spark, batches):
    j = F.when(F.col("value") < 20, "low").when(F.col("value") >= 100, "high").when(F.col("value") < 60, "mid")
    pick = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "ts", j.alias("j"))
    many = streams.changes(pick(stream(spark, batches)), "chg", "user_id", "j", ["ts", "event_id"], week)
    p = pick(spark.read.parquet(batches)).toPandas().dropna().sort_values(["user_id", "ts", "event_id"])
    p["old"] = p.groupby("user_id").j.shift(1)
    want = p[p.old.notna() & (p.old != p.j)]
    assert {(r.event_id, r.old_value, r.j) for r in many.collect()} == set(zip(want.event_id, want.old, want.j))


def test_fan_out_keeps_rows_not_pairs(spark, batches):
    """One hot group and many batches: every pair comes out, and the folder holds events and receivers only."""
    to = spark.createDataFrame([(0 if k < 90 else k, k) for k in range(100)], "n bigint, receiver bigint")
    pick = lambda df: df.select("event_id", F.when(F.col("user_id") % 3 > 0, 0).otherwise(F.col("user_id")).cast("bigint").alias("n"))
    before = set(Path(shared_dir(spark)).glob("fan-*"))
    got = streams.fanned_out(pick(stream(spark, batches)), "fan", to, "n").select("event_id", "receiver").collect()
    events = pick(spark.read.parquet(batches))
    want = events.join(to, "n").select("event_id", "receiver").collect()
    assert len(want) > 90 * events.count() / 2 and sorted(got) == sorted(want)
    (folder,) = set(Path(shared_dir(spark)).glob("fan-*")) - before
    assert sum(pq.read_metadata(f).num_rows for f in folder.rglob("*.parquet")) <= events.count() + 4 * 100


def test_fan_out_query_writes_fewer_rows_than_pairs(spark):
    load_all()
    before = set(Path(shared_dir(spark)).glob("fanout-*"))
    pairs = QUERIES["st04_fan_out_on_start"](spark, "/root/testdata/sf0.01").count()
    (folder,) = set(Path(shared_dir(spark)).glob("fanout-*")) - before
    assert 0 < sum(pq.read_metadata(f).num_rows for f in folder.rglob("*.parquet")) < pairs / 2


def test_compaction_keeps_the_latest(spark, batches):
    got = {r.user_id: r.event_id for r in streams.compacted(stream(spark, batches), "cmp", "user_id", ["ts", "event_id"], ["event_id"]).collect()}
    want = spark.read.parquet(batches).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e"))
    assert got == {r.user_id: r.e for r in want.collect()}


def test_load_outcomes_and_history(spark):
    stored = spark.createDataFrame([(1, "a", "current"), (2, "a", "archived"), (3, "a", "current")], "k int, digest string, status string")
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "k int, digest string")
    assert {r.k: r.outcome for r in publish.load_outcome(new, stored, ["k"]).collect()} == {1: "ALREADY_PUBLISHED", 2: "SUPERSEDED", 3: "CONFLICT", 4: "PUBLISHED"}
    h = publish.history_rows(stored.select("k", "digest"), new, ["k"], ["digest"]).collect()
    assert {(r.k, r.old_value, r.new_value) for r in h} == {(3, "a", "b"), (4, None, "a")}


def test_written_rows_are_sealed(spark, tmp_path):
    """Counts and digests are observed while writing; an empty table is written and checked too."""
    from phasemill.sources import ingest as src

    df = spark.range(100).selectExpr("id % 7 AS k", "CASE WHEN id % 5 = 0 THEN NULL ELSE id END AS v")
    assert tuple(src.written_and_checked(df, str(tmp_path / "a")).head()) == (100, 100, True)
    assert tuple(src.written_and_checked(df.filter("k > 9"), str(tmp_path / "b")).head()) == (0, 0, True)


def test_precision_recall_of_scores_outside_the_unit_interval(spark):
    from phasemill.operators import statistics as st

    rows = [(float(s), bool(k % 3)) for k, s in enumerate([-40, -3.5, -3.5, 0, 0.2, 7, 900, 900, 12])]
    got = sorted(((r.threshold, r.tp, r.fp) for r in st.precision_recall(spark.createDataFrame(rows, "score double, positive boolean")).collect()), reverse=True)
    assert got == [(x, sum(p for s, p in rows if s >= x), sum(not p for s, p in rows if s >= x)) for x in sorted({s for s, _ in rows}, reverse=True)]
    assert st.precision_recall(spark.createDataFrame([], "score double, positive boolean")).count() == 0
    one = st.precision_recall(spark.createDataFrame([(2.0, True), (2.0, False)], "score double, positive boolean")).collect()
    assert [(r.tp, r.fp) for r in one] == [(1, 1)]
