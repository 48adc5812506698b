"""Interval and point-in-interval joins as bucketed equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _buckets(lo: Column, hi: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / width).cast("bigint"), F.floor(hi / width).cast("bigint")))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], l_span: tuple[str, str], r_span: tuple[str, str],
                 width: float) -> DataFrame:
    """Pairs whose closed intervals overlap, each pair once.

    Both sides go into buckets of ``width``; a pair is reported only in the first
    bucket both touch, so no de-duplication shuffle follows. The equi-key is
    ``(keys, bucket)``: one long-lived key spreads over its buckets.
    """
    a = left.withColumn("_bucket", _buckets(F.col(l_span[0]), F.col(l_span[1]), width))
    b = right.withColumn("_bucket", _buckets(F.col(r_span[0]), F.col(r_span[1]), width))
    first = F.floor(F.greatest(l_span[0], r_span[0]) / width).cast("bigint")
    return (a.join(b, keys + ["_bucket"])
            .filter((F.greatest(l_span[0], r_span[0]) <= F.least(l_span[1], r_span[1])) & (F.col("_bucket") == first))
            .drop("_bucket"))


def point_join(points: DataFrame, spans: DataFrame, keys: list[str], point: str, lo: str, hi: str, width: float,
               condition: Column) -> DataFrame:
    """Points with every span that covers them. ``condition`` decides the edges."""
    a = points.withColumn("_bucket", F.floor(F.col(point) / width).cast("bigint"))
    b = spans.withColumn("_bucket", _buckets(F.col(lo), F.col(hi), width))
    return a.join(b, keys + ["_bucket"]).filter(condition).drop("_bucket")
