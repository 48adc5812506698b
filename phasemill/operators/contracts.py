"""Contracts, quarantine and ledgers: every check is one aggregate or one column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def any_null(names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null when none does. A null condition does not hold."""
    out = F.lit(None).cast("string")
    for name, cond in reversed(rules):
        out = F.when(F.coalesce(cond, F.lit(False)), name).otherwise(out)
    return out


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in rule order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules]))


def key_contract(df: DataFrame, key: list[str], *, constant: str | None = None, equal: tuple[str, str] | None = None) -> DataFrame:
    """Row count, null keys, duplicate keys and the two column rules, as one row.

    Duplicates are counted by a (key) aggregate with map-side combine, then summed.
    """
    per_key = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum((~F.col(equal[0]).eqNullSafe(F.col(equal[1]))).cast("bigint")).alias("_neq") if equal else F.lit(0).cast("bigint").alias("_neq"),
        F.min(constant).alias("_lo") if constant else F.lit(None).cast("string").alias("_lo"),
        F.max(constant).alias("_hi") if constant else F.lit(None).cast("string").alias("_hi"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
        F.coalesce(F.sum(F.when(any_null(key), F.col("_n"))), F.lit(0)).alias("n_null_key"),
        F.count_if(F.col("_n") > 1).alias("n_duplicate_keys"), F.coalesce(F.sum("_neq"), F.lit(0)).alias("n_unequal"),
        F.min("_lo").eqNullSafe(F.max("_hi")).alias("is_constant"))


def spelled(c: Column) -> tuple[Column, Column]:
    """A double without non-finite values, and the spelling of the value that was not finite."""
    odd = F.isnan(c) | (F.abs(c) == float("inf"))
    text = F.when(F.isnan(c), "NaN").when(c == float("inf"), "+Infinity").when(c == float("-inf"), "-Infinity")
    return F.when(~odd, c), text


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def text_search(posts: DataFrame, *, q: str = "", author: str = "", board: str = "", body: str = "text",
                author_col: str = "source", board_col: str = "lang") -> DataFrame:
    """All given conditions; the text is matched as it is, without regard to case."""
    out = posts
    if q:
        out = out.filter(F.col(body).ilike(f"%{escape_like(q)}%"))
    if author:
        out = out.filter(F.lower(author_col) == author.lower())
    if board:
        out = out.filter(F.col(board_col) == board.lower())
    return out


def visible(posts: DataFrame, members: DataFrame) -> DataFrame:
    """Visible posts of active authors."""
    active = members.filter(F.col("status") == "active").select(F.col("user_id").alias("author_id"))
    return posts.filter(F.col("status") == "visible").join(active, "author_id", "left_semi")


def history(subs: DataFrame, *, owner=None, star=None, results: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Half-open time range and optional equality conditions."""
    out = subs
    if owner is not None:
        out = out.filter(F.col("user_id") == owner)
    if star is not None:
        out = out.filter(F.col("star_id") == star)
    if results:
        out = out.filter(F.col("match_result").isin(results))
    if start is not None:
        out = out.filter(F.col("created_at") >= F.to_timestamp_ntz(F.lit(start)))
    if end is not None:
        out = out.filter(F.col("created_at") < F.to_timestamp_ntz(F.lit(end)))
    return out


def in_box(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows with x and y in [min, max); plain comparisons, so they reach the scan."""
    x0, x1, y0, y1 = box
    return df.filter((F.col(x) >= x0) & (F.col(x) < x1) & (F.col(y) >= y0) & (F.col(y) < y1))


def tile(c: str, width: float) -> Column:
    """Lower edge of the tile; tiles are half-open, so no row is in two."""
    return F.floor(F.col(c) / width) * width
