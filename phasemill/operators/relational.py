"""Joins, selections and pages over entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasemill.operators.ordered import numbered
from phasemill.operators.sizing import small


def select_rows(heavy: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the chosen ids; the id list is broadcast when measured to be small."""
    return heavy.join(small(ids.select(key).distinct()), key, "left_semi")


def changed_entities(rows: DataFrame, key: str, touched: Column, *, bucket: tuple[int, int] | None = None) -> DataFrame:
    """All rows of every entity that has a touched row, optionally of one hash bucket."""
    ids = rows.filter(touched).select(key).distinct()
    if bucket:
        ids = ids.filter(F.pmod(F.col(key), F.lit(bucket[0])) == bucket[1])
    return rows.join(ids, key, "left_semi")


def reconcile_keys(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, labelled missing or unexpected."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return (e.join(a, key, "left_anti").withColumn("side", F.lit("missing"))
            .unionByName(a.join(e, key, "left_anti").withColumn("side", F.lit("unexpected"))))


def evidence_agreement(expected: DataFrame, actual: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Full outer match; which side has the key and which fields differ."""
    e = expected.select(*key, *[F.col(f).alias(f"e_{f}") for f in fields], F.lit(True).alias("_e"))
    a = actual.select(*key, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("_a"))
    x = e.join(a, key, "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"e_{f}").eqNullSafe(F.col(f"a_{f}")), f) for f in fields]))
    verdict = (F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected")
               .when(F.size(differ) > 0, "differs").otherwise("agrees"))
    return x.select(*key, verdict.alias("verdict"), F.concat_ws(",", differ).alias("fields"))


def weekly_spine(keys: DataFrame, last_week: str, weeks: int) -> DataFrame:
    """Every key with each of the last ``weeks`` weeks; the current one is partial."""
    end = F.to_date(F.lit(last_week))
    spine = F.explode(F.sequence(F.date_sub(end, 7 * (weeks - 1)), end, F.expr("interval 7 days")))
    return keys.withColumn("week_start", spine).withColumn("partial", F.col("week_start") == end)


def after_cursor(df: DataFrame, newest: str, tie: str, at, tie_id, *, tie_desc: bool = False) -> DataFrame:
    """Rows behind a (time desc, id) cursor; written out so both parts reach the scan."""
    at = F.to_timestamp_ntz(F.lit(at))
    beyond = F.col(tie) < tie_id if tie_desc else F.col(tie) > tie_id
    return df.filter((F.col(newest) < at) | ((F.col(newest) == at) & beyond))


def page(df: DataFrame, newest: str, tie: str, size: int, *, tie_desc: bool = False) -> DataFrame:
    """One page plus one row that shows whether more follow."""
    return df.orderBy(F.desc(newest), F.desc(tie) if tie_desc else F.asc(tie)).limit(size + 1)


def row_at(pool: DataFrame, key: str, seed: int, *, block: int = 100_000) -> DataFrame:
    """The row at position seed mod pool size in key order, without sorting the pool.

    Block counts locate the block (a bounded frame), then only that block is ranked.
    """
    blocks = pool.groupBy(F.floor(F.col(key) / block).alias("_blk")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_blk")
    blocks = blocks.withColumns({"_end": F.sum("_n").over(w), "_total": F.sum("_n").over(Window.partitionBy())})
    want = F.lit(seed) % F.col("_total")
    hit = blocks.filter((F.col("_end") > want) & (F.col("_end") - F.col("_n") <= want)).select("_blk", (want - F.col("_end") + F.col("_n")).alias("_off"))
    inside = pool.withColumn("_blk", F.floor(F.col(key) / block)).join(F.broadcast(hit), "_blk")
    return (inside.withColumn("_rn", F.row_number().over(Window.partitionBy("_blk").orderBy(key)))
            .filter(F.col("_rn") == F.col("_off") + 1).select(*pool.columns))


def decimate(df: DataFrame, keys: list[str], order: list[str], chunk: Column, at_most: int) -> DataFrame:
    """At most ``at_most`` rows per key at evenly spaced ranks, ends included."""
    x = numbered(df, keys, order, chunk, "_rank")
    x = x.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")), keys)
    r, last, steps = F.col("_rank") - 1, F.col("_size") - 1, at_most - 1
    nearest = F.ceil(r * steps / F.greatest(last, F.lit(1)))
    chosen = (F.col("_size") <= at_most) | ((nearest <= steps) & (F.floor(nearest * last / steps) == r))
    return x.filter(chosen).select(*df.columns)


def contiguous_watermark(parts: DataFrame, key: str, part: str, first: int) -> DataFrame:
    """Largest part up to which every part from ``first`` on is present."""
    x = parts.select(key, part).distinct()
    w = Window.partitionBy(key).orderBy(part)  # bounded: distinct parts of one key
    x = x.withColumn("_ok", F.col(part) == F.row_number().over(w) + (first - 1))
    return x.groupBy(key).agg(F.max(F.when(F.col("_ok"), F.col(part))).alias("through"))
