"""Ordered scans (lag, lead, running totals) that split a hot key into chunks.

A window over one key runs in one task. When a key may hold a third of all rows
that task is the job, so every scan here runs over ``(key, chunk)`` and then
stitches the chunk edges: one summary row per chunk, one small window over the
summaries, one join back on the partitioning the first window already produced.
``chunk`` is any column that is monotone in the order, such as a day number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _names(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def with_neighbours(df: DataFrame, keys, order: list[str], cols: list[str], chunk: Column,
                    *, before: bool = True, after: bool = False) -> DataFrame:
    """Add ``prev_<col>`` and/or ``next_<col>`` of the neighbouring row in order."""
    keys, order = _names(keys), list(order)
    x = df.withColumn("_chunk", chunk)
    part = keys + ["_chunk"]
    rank = F.struct(*order)
    row = F.struct(*[F.col(c).alias(c) for c in cols])
    aggs = []
    if before:
        aggs.append(F.max_by(row, rank).alias("_last"))
    if after:
        aggs.append(F.min_by(row, rank).alias("_first"))
    edges = x.groupBy(*part).agg(*aggs)
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    if before:
        edges = edges.withColumn("_last", F.lag("_last").over(over_chunks))
    if after:
        edges = edges.withColumn("_first", F.lead("_first").over(over_chunks))
    w = Window.partitionBy(*part).orderBy(*order)
    if before:
        x = x.withColumn("_lag", F.lag(row).over(w))
    if after:
        x = x.withColumn("_lead", F.lead(row).over(w))
    x = x.join(edges, part, "left")
    out = [F.col(c) for c in df.columns]
    for c in cols:
        if before:
            out.append(F.coalesce(F.col("_lag"), F.col("_last"))[c].alias(f"prev_{c}"))
        if after:
            out.append(F.coalesce(F.col("_lead"), F.col("_first"))[c].alias(f"next_{c}"))
    return x.select(*out)


def running_sum(df: DataFrame, keys, order: list[str], value: Column, chunk: Column, name: str,
                *, cast: str = "bigint", exclusive: bool = False) -> DataFrame:
    """Add the running total of ``value`` in order, per key."""
    keys = _names(keys)
    x = df.withColumn("_chunk", chunk).withColumn("_val", value.cast(cast))
    part = keys + ["_chunk"]
    totals = x.groupBy(*part).agg(F.sum("_val").alias("_total"))
    ahead = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*part, F.coalesce(F.sum("_total").over(ahead), F.lit(0).cast(cast)).alias("_offset"))
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    x = x.withColumn("_run", F.coalesce(F.sum("_val").over(w), F.lit(0).cast(cast))).join(totals, part, "left")
    return x.select(*df.columns, (F.col("_run") + F.col("_offset")).cast(cast).alias(name))


def numbered(df: DataFrame, keys, order: list[str], chunk: Column, name: str) -> DataFrame:
    """Add the 1-based row number in order, per key."""
    return running_sum(df, keys, order, F.lit(1), chunk, name)


def bracketing(df: DataFrame, keys, order: list[str], is_anchor: Column, cols: list[str], chunk: Column) -> DataFrame:
    """Add the nearest anchor row at or before and at or after each row.

    New columns are ``lo_<col>`` and ``hi_<col>``; null where no anchor exists on that side.
    """
    keys, order = _names(keys), list(order)
    part = keys + ["_chunk"]
    row = F.when(is_anchor, F.struct(*[F.col(c).alias(c) for c in cols]))
    x = df.withColumn("_chunk", chunk).withColumn("_anchor", row)
    rank = F.struct(*order)
    edges = x.groupBy(*part).agg(
        F.max_by("_anchor", F.when(F.col("_anchor").isNotNull(), rank)).alias("_l"),
        F.min_by("_anchor", F.when(F.col("_anchor").isNotNull(), rank)).alias("_h"),
    )
    wc = Window.partitionBy(*keys).orderBy("_chunk")
    edges = edges.select(
        *part,
        F.last("_l", True).over(wc.rowsBetween(Window.unboundedPreceding, -1)).alias("_edge_lo"),
        F.first("_h", True).over(wc.rowsBetween(1, Window.unboundedFollowing)).alias("_edge_hi"),
    )
    w = Window.partitionBy(*part).orderBy(*order)
    x = (x.withColumn("_lo", F.last("_anchor", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
          .withColumn("_hi", F.first("_anchor", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
          .join(edges, part, "left"))
    out = [F.col(c) for c in df.columns]
    for c in cols:
        out.append(F.coalesce(F.col("_lo"), F.col("_edge_lo"))[c].alias(f"lo_{c}"))
        out.append(F.coalesce(F.col("_hi"), F.col("_edge_hi"))[c].alias(f"hi_{c}"))
    return x.select(*out)


def segmented(df: DataFrame, keys, order: list[str], coord: str, gap: float, chunk: Column, name: str = "segment_id",
              *, inclusive: bool = False, position: str | None = None) -> DataFrame:
    """Number the runs of each key: a new run starts where the step in ``coord`` exceeds ``gap``.

    ``position`` also numbers the rows within their run. Inside a chunk both come from
    one sorted pass; one summary row per chunk then says how many runs lie before it
    and how many rows of its first run lie in earlier chunks.
    """
    keys, order = _names(keys), list(order)
    part = keys + ["_chunk"]
    opens = (lambda step: step >= gap) if inclusive else (lambda step: step > gap)
    w = Window.partitionBy(*part).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("_chunk", chunk)
    x = x.withColumns({"_open": F.coalesce(opens(F.col(coord) - F.lag(coord).over(w)), F.lit(False)), "_rn": F.row_number().over(w)})
    x = x.withColumns({"_run": F.sum(F.col("_open").cast("bigint")).over(upto),
                       "_from": F.coalesce(F.last(F.when(F.col("_open"), F.col("_rn") - 1), True).over(upto), F.lit(0))})
    c = x.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), F.max("_run").alias("_opens"), F.max("_from").alias("_tail"),
                             F.min_by(coord, "_rn").alias("_first"), F.max_by(coord, "_rn").alias("_last"))
    wc = Window.partitionBy(*keys).orderBy("_chunk")
    before = wc.rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumns({"_edge": F.coalesce(opens(F.col("_first") - F.lag("_last").over(wc)), F.lit(False)), "_rows": F.coalesce(F.sum("_n").over(before), F.lit(0))})
    c = c.withColumn("_mark", F.when(F.col("_opens") > 0, F.col("_rows") + F.col("_tail")).when(F.col("_edge"), F.col("_rows")))
    c = c.select(*part, (F.coalesce(F.sum("_opens").over(before), F.lit(0)) + F.sum(F.col("_edge").cast("bigint")).over(wc)).alias("_base"),
                 F.when(F.col("_edge"), 0).otherwise(F.col("_rows") - F.coalesce(F.last("_mark", True).over(before), F.lit(0))).alias("_carry"))
    x = x.join(c, part)
    out = [*df.columns, (F.col("_run") + F.col("_base")).alias(name)]
    if position:
        out.append((F.col("_rn") - F.col("_from") + F.when(F.col("_run") == 0, F.col("_carry")).otherwise(0)).alias(position))
    return x.select(*out)


def latest(df: DataFrame, keys, order: list, *, first: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One whole row per key, the last (or first) in order.

    ``max_by`` combines on the map side, so a hot key ships one row per task
    where a ``row_number`` window would ship them all.
    """
    keys = _names(keys)
    cols = [c for c in (keep or df.columns) if c not in keys]
    pick = F.min_by if first else F.max_by
    rank = order[0] if len(order) == 1 else F.struct(*order)
    return df.groupBy(*keys).agg(pick(F.struct(*cols), rank).alias("_row")).select(*keys, "_row.*")
