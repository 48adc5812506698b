"""Digests of rows, record sets and arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the four bytes that stand for a null element of a float32 array.
NULL_FLOAT = b"\x00\x00\xc0\x7f"


def canonical_json(cols: list[str]) -> Column:
    """Compact JSON with sorted keys; a null field is written as null."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})


def content_hash(cols: list[str]) -> Column:
    return F.sha2(canonical_json(cols), 256)


LANES = 5
LANE_HEX = 12
#: Bits of the lower part of a lane: both parts are summed as longs, which hold 2^39 rows.
LOW_BITS = 24


def record_set_digest(df: DataFrame, keys: list[str], cols: list[str], also: Sequence[Column] = ()) -> DataFrame:
    """Order-independent digest of each group's rows, copies counted.

    The SHA-256 of each row's canonical JSON is cut into lanes of 48 bits and the
    lanes are summed; the digest is the SHA-256 of count and sums. Sums combine on
    the map side, so no group is ever sorted or collected, whatever its size. Rows
    that carry their sort key fix the order as well. ``also`` are named aggregates of
    the same groups.
    """
    x = df.withColumn("_h", F.sha2(canonical_json(cols), 256))
    x = x.withColumns({f"_l{i}": F.conv(F.substring("_h", 1 + i * LANE_HEX, LANE_HEX), 16, 10).cast("bigint") for i in range(LANES)})
    high = [F.sum(F.shiftright(f"_l{i}", LOW_BITS)).alias(f"_s{i}") for i in range(LANES)]
    low = [F.sum(F.col(f"_l{i}").bitwiseAND((1 << LOW_BITS) - 1)).alias(f"_t{i}") for i in range(LANES)]
    sums = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *high, *low, *also)
    total = lambda i: (F.col(f"_s{i}").cast("decimal(25,0)") * F.lit(1 << LOW_BITS) + F.col(f"_t{i}")).cast("decimal(25,0)")
    text = F.concat_ws(":", F.col("n_rows"), *[total(i).cast("string") for i in range(LANES)])
    digest = F.sha2(text, 256).alias("digest")
    return sums.withColumn("digest", digest).drop(*[f"_{c}{i}" for c in "st" for i in range(LANES)])


def hash_bucket(c: Column, n: int) -> Column:
    """First eight bytes of SHA-256, modulo n."""
    return (F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("bigint")


def _float32_digests(arrays: pd.Series, gaps: pd.Series) -> pd.Series:
    out = []
    for a, gone in zip(arrays, gaps):
        if a is None:
            out.append(None)
            continue
        gone = np.asarray(gone, dtype=bool)
        f = np.where(gone, 0.0, np.asarray(a, dtype=np.float64)).astype("<f4") + np.float32(0.0)
        if not np.isfinite(f).all():
            raise ValueError("non-finite element")
        words = f.view("<u4")
        words[gone] = int.from_bytes(NULL_FLOAT, "little")
        out.append("sha256:" + hashlib.sha256(words.tobytes()).hexdigest())
    return pd.Series(out)


def array_checksum(c: Column) -> Column:
    """SHA-256 of the little-endian float32 bytes; a null has its own pattern, -0 counts as +0.

    Arrow hands a null element over as NaN, so the null positions travel beside the values.
    """
    return F.pandas_udf(_float32_digests, "string")(c, F.transform(c, lambda x: x.isNull()))
