"""Small scalar rules: local time, epochs, text, identifiers, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The service time zone and the epoch scale constants.
LOCAL_ZONE = "Asia/Seoul"
BTJD_OFFSET = 2457000.0
UTC_TO_TDB_DAYS = 69.184 / 86400


def local_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), LOCAL_ZONE))


def local_week(ts: Column) -> Column:
    """Monday of the local week."""
    return F.to_date(F.date_trunc("week", F.from_utc_timestamp(ts.cast("timestamp"), LOCAL_ZONE)))


def to_btjd(value: Column, scale: Column) -> Column:
    """Epoch in the common scale; null where the scale is not known."""
    return (F.when(scale == "BTJD-TDB", value).when(scale == "BJD-TDB", value - BTJD_OFFSET)
            .when(scale == "BJD-UTC", value + UTC_TO_TDB_DAYS - BTJD_OFFSET))


def trimmed(c: Column) -> Column:
    """Decimal text without trailing zeros."""
    text = c.cast("decimal(20,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def json_strings(c: Column) -> Column:
    """Elements of a JSON array of strings; an empty array for anything else."""
    return F.when(F.substring(F.trim(c), 1, 1) == "[", F.from_json(c, "array<string>")).otherwise(F.array().cast("array<string>"))


def hash_parity(c: Column) -> Column:
    """First byte of SHA-256 of the text, modulo 2."""
    return (F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 2), 16, 10).cast("bigint") % 2).cast("bigint")
