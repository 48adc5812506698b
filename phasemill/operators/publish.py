"""Versioned publication: states, upserts, history, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasemill.functions.hashing import record_set_digest
from phasemill.operators.ordered import latest
from phasemill.operators.sizing import tasks_for
from phasemill.session import cut_lineage


def size_plan(rows: DataFrame, entity: str, *, per_row: int, per_entity: int, budget: int) -> DataFrame:
    """Estimated output against the budget, from one narrow aggregate."""
    per = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    x = per.agg(F.count(F.lit(1)).alias("n_entities"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"))
    x = x.withColumn("estimated_bytes", F.col("n_rows") * per_row + F.col("n_entities") * per_entity)
    return x.withColumn("within_budget", F.col("estimated_bytes") <= budget)


def pending(inputs: DataFrame, previous: DataFrame, key: list[str]) -> DataFrame:
    """Rows without an earlier success on the same input hash."""
    return inputs.join(previous.filter("ok").select(*key, "input_hash").distinct(), [*key, "input_hash"], "left_anti")


def compare_rows(a: DataFrame, b: DataFrame, key: list[str], exact: list[str], floats: list[str], rtol: float) -> DataFrame:
    """Full outer comparison: coverage, exact columns, and doubles within a relative tolerance."""
    l = a.select(*key, *[F.col(c).alias(f"l_{c}") for c in exact + floats], F.lit(True).alias("_l"))
    r = b.select(*key, *[F.col(c).alias(f"r_{c}") for c in exact + floats], F.lit(True).alias("_r"))
    x = l.join(r, key, "full_outer")
    bad = [F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), c) for c in exact]
    near = lambda c: F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")) <= rtol * F.greatest(F.abs(f"l_{c}"), F.abs(f"r_{c}"))
    bad += [F.when(~F.coalesce(near(c), F.col(f"l_{c}").isNull() & F.col(f"r_{c}").isNull()), c) for c in floats]
    verdict = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(F.size(F.array_compact(F.array(*bad))) > 0, "differs").otherwise("equal")
    return x.select(*key, verdict.alias("verdict"), F.concat_ws(",", F.array_compact(F.array(*bad))).alias("columns"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """New snapshot: the new value of each column where there is one, the old one otherwise."""
    o = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in cols])
    n = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in cols])
    return o.join(n, key, "full_outer").select(*key, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in cols])


def hash_upsert(old: DataFrame, new: DataFrame, key: list[str], cols: list[str], stamp: Column) -> DataFrame:
    """Like an upsert, but ``changed_at`` moves only when content or status does; rows gone from the source become inactive."""
    h = lambda: F.sha2(F.to_json(F.struct(*cols)), 256)
    o = old.select(*key, F.struct(*cols).alias("_o"), h().alias("_oh"), "status", "changed_at")
    n = new.select(*key, F.struct(*cols).alias("_n"), h().alias("_nh"))
    x = o.join(n, key, "full_outer")
    status = F.when(F.col("_nh").isNull(), "inactive").otherwise("active")
    moved = F.col("_oh").isNull() | (status != F.col("status")) | (F.col("_nh").isNotNull() & (F.col("_nh") != F.col("_oh")))
    return x.select(*key, F.coalesce("_n", "_o").alias("_c"), status.alias("new_status"), F.when(moved, stamp).otherwise(F.col("changed_at")).alias("changed_at")).select(
        *key, "_c.*", F.col("new_status").alias("status"), "changed_at")


def history_rows(old: DataFrame, new: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """One row per key and column whose value changed."""
    o = old.select(*key, *[F.col(c).cast("string").alias(f"_o_{c}") for c in cols])
    n = new.select(*key, *[F.col(c).cast("string").alias(f"_n_{c}") for c in cols])
    x = o.join(n, key, "full_outer")
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_o_{c}").alias("old_value"), F.col(f"_n_{c}").alias("new_value")) for c in cols])
    return x.select(*key, F.explode(rows).alias("r")).select(*key, "r.*").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def switch_current(versions: DataFrame, key: str, version: str) -> DataFrame:
    """Exactly one current version per key, the newest; the others are archived."""
    top = versions.groupBy(key).agg(F.max(version).alias("_top"))
    return versions.join(top, key).withColumn("status", F.when(F.col(version) == F.col("_top"), "current").otherwise("archived")).drop("_top")


def load_outcome(incoming: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """PUBLISHED, ALREADY_PUBLISHED, SUPERSEDED or CONFLICT, by version and digest."""
    s = stored.select(*key, F.col("digest").alias("_d"), F.col("status").alias("_s"))
    x = incoming.join(s, key, "left")
    code = (F.when(F.col("_d").isNull(), "PUBLISHED").when(F.col("_d") != F.col("digest"), "CONFLICT")
            .when(F.col("_s") == "current", "ALREADY_PUBLISHED").otherwise("SUPERSEDED"))
    return x.withColumn("outcome", code).drop("_d", "_s")


def refresh_targets(rows: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of refreshed keys replaced, the others kept."""
    return rows.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def reuse_children(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Keep a stored child whose key and checksum agree; a differing checksum is a conflict."""
    s = stored.select(*key, F.col("child_id").alias("_id"), F.col("checksum").alias("_c"))
    x = incoming.join(s, key, "left")
    action = F.when(F.col("_c").isNull(), "insert").when(F.col("_c") == F.col("checksum"), "keep").otherwise("conflict")
    return x.select(*key, action.alias("action"), F.col("_id").alias("kept_id"))


def current_state(stages: DataFrame, key: str, order: dict[str, int]) -> DataFrame:
    """State of an entity: the first failed stage decides; a retryable failure means unprocessed."""
    rank = F.coalesce(*[F.when(F.col("stage") == k, v) for k, v in order.items()])
    bad = F.when(F.col("status") == "failed", rank)
    x = stages.groupBy(key).agg(F.min_by(F.struct("stage", "retryable"), bad).alias("f"), F.count_if(F.col("status") == "ok").alias("n_ok"))
    state = F.when(F.col("f").isNull() & (F.col("n_ok") >= len(order)), "processed").when(F.col("f").isNull(), "unprocessed").when(F.col("f.retryable"), "unprocessed").otherwise("rejected")
    return x.select(key, state.alias("state"), F.col("f.stage").alias("failed_stage"))


def violations(rules: list[tuple]) -> DataFrame:
    """(rule, key, times) rows of several checks (rule, rows, key[, how often a row counts])."""
    out = None
    for name, df, key, *times in rules:
        row = df.select(F.lit(name).alias("rule"), key.cast("string").alias("key"), (times[0] if times else F.lit(1)).cast("bigint").alias("times"))
        out = row if out is None else out.unionByName(row)
    return out


def family_rules(parents: DataFrame, children: DataFrame, key: str, child: str, copies: int) -> list[tuple]:
    """Children that come more than ``copies`` times, parents without children, children without parents.

    Children are dealt by (key, child) and keys by key, over measured numbers of tasks, and only counted
    there: no table of a map task holds its whole split, and a key of any size is one count.
    """
    tasks = tasks_for(parents, children)
    kids = children.select(key, child).repartition(tasks, key, child).groupBy(key, child).agg(F.count(F.lit(1)).alias("_c"))
    ends = kids.select(key, F.lit(True).alias("_kid")).unionByName(parents.select(key, F.lit(False).alias("_kid")))
    ends = ends.repartition(tasks, key).groupBy(key).agg(F.count_if("_kid").alias("_kids"), F.count_if(~F.col("_kid")).alias("_parents"))
    alone = lambda other: (F.col(other) == 0) | F.col(key).isNull()  # a key that is null meets none
    return [("duplicate_child", kids.filter(F.col("_c") > copies), F.concat_ws("/", key, child)),
            ("missing_children", ends.filter((F.col("_parents") > 0) & alone("_kids")), F.col(key), F.col("_parents")),
            ("orphan_child", ends.filter((F.col("_kids") > 0) & alone("_parents")), F.col(key))]


def gate(rules: list[tuple]) -> DataFrame:
    """Per rule all its violations counted, the least key and the verdict; the row ``all`` judges the publication."""
    found = violations(rules).groupBy("rule").agg(F.sum("times").alias("_n"), F.min("key").alias("_key"))
    names = rules[0][1].sparkSession.createDataFrame([(name,) for name, *_ in rules], "rule string")
    total = F.coalesce(F.sum("_n"), F.lit(0))
    x = names.join(found, "rule", "left").rollup("rule").agg(total.alias("n_violations"), F.min("_key").alias("first_key"), F.when(total > 0, "hold").otherwise("publish").alias("verdict"))
    return x.select(F.coalesce("rule", F.lit("all")).alias("rule"), "n_violations", "first_key", "verdict")


def bundle_rules(payload: DataFrame, manifest: DataFrame, candidates: DataFrame, *, key: str, child: str, cols: list[str], active: Column) -> list[tuple[str, DataFrame, Column]]:
    """Rules for ``gate``: each bundle of child rows against its manifest entry, and the active ones against the candidate table.

    ``manifest`` has the key, ``digest`` (of ``cols``), ``n_active`` and ``n_retired``; ``candidates`` the key and the child.
    """
    made = record_set_digest(payload, [key], cols, [F.count_if(active).alias("_on"), F.count_if(~active).alias("_off")]).drop("n_rows").withColumnRenamed("digest", "_made")
    x = cut_lineage(made.join(manifest.select(key, "digest", "n_active", "n_retired"), key, "full_outer"))  # four rules read it
    both = F.col("_made").isNotNull() & F.col("digest").isNotNull()
    ours = payload.filter(active).select(key, child).distinct().withColumn("_a", F.lit(True))
    table = candidates.select(key, child).distinct().withColumn("_b", F.lit(True))
    apart = ours.join(table, [key, child], "full_outer").filter("_a IS NULL OR _b IS NULL").select(key).distinct()
    return [("bundle_not_in_manifest", x.filter("digest IS NULL"), F.col(key)), ("bundle_missing", x.filter("_made IS NULL"), F.col(key)),
            ("checksum_mismatch", x.filter(both & (F.col("_made") != F.col("digest"))), F.col(key)),
            ("candidate_counts_differ", x.filter(both & ((F.col("_on") != F.col("n_active")) | (F.col("_off") != F.col("n_retired")))), F.col(key)),
            ("candidate_table_differs", apart, F.col(key))]


def roll_up(targets: DataFrame, results: DataFrame, candidates: DataFrame, *, run: str, target: str, statuses: list[str], candidate: str, cols: list[str],
            unfinished: tuple[str, ...] = ("unprocessed", "request_failed")) -> DataFrame:
    """One manifest row per run: every target accounted for, counts by status, completeness and the candidates' digest.

    A target without a result is ``unprocessed``. Results outside the targets, several results of one target and
    repeated candidate ids reject the run.
    """
    one = results.groupBy(run, target).agg(F.count(F.lit(1)).alias("_n"), F.max("status").alias("status"))
    x = targets.select(run, target).distinct().withColumn("_t", F.lit(True)).join(one, [run, target], "full_outer")
    mine, state = F.col("_t").isNotNull(), F.coalesce("status", F.lit("unprocessed"))
    x = x.groupBy(run).agg(F.count_if(mine).alias("n_targets"), *[F.count_if(mine & (state == s)).alias(f"n_{s}") for s in statuses],
                           F.count_if(~mine).alias("outside_targets"), F.count_if(F.col("_n") > 1).alias("repeated_results"))
    ids = candidates.groupBy(run, candidate).agg(F.count(F.lit(1)).alias("_n")).groupBy(run).agg(F.sum("_n").alias("n_candidates"), F.count_if(F.col("_n") > 1).alias("repeated_candidates"))
    seal = record_set_digest(candidates, [run], cols).select(run, F.col("digest").alias("candidates_digest"))
    x = x.join(ids, run, "left").join(seal, run, "left").fillna(0, ["n_candidates", "repeated_candidates"])
    open_ = sum((F.col(f"n_{s}") for s in unfinished if s in statuses), F.lit(0))
    reason = (F.when(F.col("outside_targets") > 0, "result_outside_targets").when(F.col("repeated_results") > 0, "duplicate_target_result")
              .when(F.col("repeated_candidates") > 0, "duplicate_candidate_id"))
    return x.withColumns({"reason": reason, "status": F.when(reason.isNotNull(), "rejected").when(open_ == 0, "complete").otherwise("incomplete")})


def prune(rows: DataFrame, *, done: Column, since: str, before: Column) -> DataFrame:
    """Drop finished rows older than ``before``; what is unfinished or undated stays."""
    return rows.filter(~F.coalesce(done & (F.col(since) < before), F.lit(False)))


def blanked(rows: DataFrame, *, due: Column, values: dict[str, Column]) -> DataFrame:
    """Overwrite columns of the rows that are due, keeping the rows."""
    due = F.coalesce(due, F.lit(False))
    return rows.withColumns({c: F.when(due, v).otherwise(F.col(c)) for c, v in values.items()})


def anonymise(rows: DataFrame, withdrawn: DataFrame, owner: str, *, remove: Column) -> DataFrame:
    """Rows of withdrawn owners are removed where ``remove`` holds and lose their owner elsewhere."""
    w = withdrawn.select(F.col("user_id").alias(owner)).distinct().withColumn("_w", F.lit(True))
    x = rows.join(w, owner, "left")
    gone = F.coalesce(F.col("_w"), F.lit(False))
    return x.filter(~(gone & remove)).withColumn(owner, F.when(~gone, F.col(owner))).select(*rows.columns)
