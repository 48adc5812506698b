"""What the operators share: scratch tables, ASCII folding, byte views of Arrow text and word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasemill.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = "\x20\x09-\x0d"
#: Bytes of text that one NumPy step works on; longer texts are cut between words.
STEP = 1 << 20


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once into the shared folder and read back: a lost executor costs no recompute."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column laid end to end, and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
GAP = np.zeros(256, bool)
GAP[[32, 9, 10, 11, 12, 13]] = True

_rng = np.random.default_rng(20240229)
_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, n of each."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, STEP + 4096) - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, from one running sum; equal bytes give equal hashes anywhere."""
    power, inverse = _power_tables(len(data))
    with np.errstate(over="ignore"):
        run = np.concatenate([[np.uint64(0)], np.cumsum(_CODES[data] * power[: len(data)], dtype=np.uint64)])
        return mix((run[ends] - run[starts]) * inverse[np.minimum(starts, len(inverse) - 1)] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word crosses a document's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~gap[data]
    before = np.concatenate([[True], ~inside[:-1]]) | edge[:-1]
    after = np.concatenate([~inside[1:], [True]]) | edge[1:]
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def hashed_words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all documents in order, and n + 1 word offsets by document.

    Works through pieces of STEP bytes that end between words, so memory beside
    the hashes stays bounded for texts of any length (but for one endless word).
    """
    starts, ends = word_spans(data, offsets, gap)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP, "right")))
        at = starts[i]
        out[i:j] = range_hashes(data[at: ends[j - 1]], starts[i:j] - at, ends[i:j] - at)
        i = j
    return out, np.searchsorted(starts, offsets)
