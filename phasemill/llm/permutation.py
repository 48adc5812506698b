"""Document fingerprints by one-permutation MinHash with optimal densification.

The distinct shingles of ``SHINGLE`` words (as runs of characters other than ASCII
white space, A-Z folded; the whole sequence where a text has fewer) are hashed once.
The high bits of a hash name one of ``BINS`` bins and a bin keeps its least hash.
An empty bin takes the value of the first full bin in its own fixed random order
of all bins, so empty bins of two texts that are filled from one shared bin agree,
and no bin is favoured. ``BITS`` low bits of each value are packed into 64-bit
words. Of two unlike values 2^-BITS agree by chance; ``likeness`` takes that share
out again, which leaves an unbiased estimate of the Jaccard similarity but for the
cut at 0. Its deviation is sqrt(J (1 - J) / BINS) / (1 - 2^-BITS) for texts with
more shingles than bins, and of the order sqrt(J (1 - J) / n) for n shingles fewer.

A null or wordless text has no shingle and the empty fingerprint: likeness 1 to
another empty one and 0 to all else. Equal texts have equal fingerprints. Work and
memory follow the text; one long text is read in one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasemill.llm.common import FOLD, hashed_words, mix, slices, stored, text_bytes

SHINGLE, BINS, BITS = 5, 512, 4
WORDS = BINS * BITS // 64
_rng = np.random.default_rng(12)
#: For every bin its order of all bins.
_ORDER = np.argsort(_rng.random((BINS, BINS)), axis=1)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order, repeated ones too, and n + 1 offsets by document."""
    words, bounds = hashed_words(FOLD[data], offsets)
    n = np.diff(bounds)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    first = bounds[:-1][doc] + np.arange(ends[-1]) - ends[:-1][doc]
    last = bounds[1:][doc]
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    h = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(first + k < last, padded[first + k], np.uint64(k)))
    return h, ends


def bin_minima(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of every bin (documents x BINS), and which bins have one."""
    docs = len(ends) - 1
    cell = np.repeat(np.arange(docs), np.diff(ends)) * BINS + (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    order = np.lexsort((hashes, cell))
    cell, hashes = cell[order], hashes[order]
    head = np.ones(len(cell), bool)
    head[1:] = cell[1:] != cell[:-1]
    least, full = np.zeros(docs * BINS, np.uint64), np.zeros(docs * BINS, bool)
    least[cell[head]], full[cell[head]] = hashes[head], True
    return least.reshape(docs, BINS), full.reshape(docs, BINS)


def densified(least: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Every empty bin of a row with a full one takes the value of the first full bin in its order."""
    out = least.copy()
    doc, empty = np.nonzero(~full & full.any(1)[:, None])
    for attempt in range(BINS):
        if not len(doc):
            break
        source = _ORDER[empty, attempt]
        found = full[doc, source]
        out[doc[found], empty[found]] = least[doc[found], source[found]]
        doc, empty = doc[~found], empty[~found]
    return out


def packed_fingerprints(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> pa.ListArray:
    """The fingerprint of each text: WORDS 64-bit words, none for a text without words."""
    least, full = bin_minima(*shingle_hashes(data, offsets, size))
    has = full.any(1)
    low = mix(densified(least[has], full[has])) & np.uint64((1 << BITS) - 1)
    lanes = low.reshape(-1, WORDS, 64 // BITS) << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))
    values = np.bitwise_or.reduce(lanes, axis=2).ravel().view(np.int64)
    ends = np.concatenate([[0], np.cumsum(has * WORDS)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(values))


def _of(texts: list[str]) -> pa.ListArray:
    """Fingerprints of texts, a bounded number of bytes at a time."""
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    parts = [packed_fingerprints(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]) for i, j in slices(offsets)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def each(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                prints = packed_fingerprints(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], size)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), prints], ["doc_id", "fingerprint"])

    return d.mapInArrow(each, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fingerprint array<long>")


def as_text(fingerprint: Column) -> Column:
    """Sixteen hexadecimal digits a word; '' for a text without words."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity that two fingerprints let expect, 0 to 1."""
    lane = sum(1 << k for k in range(0, 64, BITS))

    def unlike(x: Column, y: Column) -> Column:
        # A lane's lowest bit is set if any bit of the lane differs.
        bits, k = x.bitwiseXOR(y), 1
        while k < BITS:
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, k))
            k *= 2
        return F.bit_count(bits.bitwiseAND(F.lit(lane)))

    differ = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda total, x: total + x)
    chance = 2.0 ** -BITS
    estimate = F.greatest(F.lit(0.0), (1 - differ / BINS - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(estimate)


def spliced(text: str, following: str) -> str:
    """The text with its last half of the code points replaced by the first as many of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = pa.schema([("pid", pa.int32()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.list_(pa.int64())),
                     ("edited_fingerprint", pa.list_(pa.int64())), ("next_fingerprint", pa.list_(pa.int64())), ("first_text", pa.string()), ("last_text", pa.string())])
_KIND = ("pid int, n_chars long, edited_sha256 binary, fingerprint array<long>, edited_fingerprint array<long>, "
         "next_fingerprint array<long>, first_text string, last_text string")


def _judged(texts: list[str]) -> list[pa.Array]:
    """n_chars, digest of the edited text and three fingerprints of all texts but the last, each beside the one after it."""
    edited = [spliced(a, b) for a, b in zip(texts, texts[1:])]
    own = _of(texts)
    return [pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(e.encode()).digest() for e in edited], pa.binary()),
            own.slice(0, len(edited)), _of(edited), own.slice(1)]


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_next) of every row beside the next one.

    Rows follow by doc_id, nulls first, equal ids by a hash of the text; after the last
    comes the first. Rows are sorted in ranges, so no task holds them all, also where
    ids repeat; each range passes on its first and last text, and these few rows (two
    a range) are joined to close the gaps between the ranges.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = d.schema["doc_id"].dataType
    keys = ["doc_id", "tie", "row"]
    d = d.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def each(batches):
        pid, alone, held = TaskContext.get().partitionId(), True, None
        for batch in batches:
            for i, j in slices(text_bytes(batch.column("text"))[1]):
                ids, texts = batch.column("doc_id").slice(i, j - i), batch.column("text").slice(i, j - i).to_pylist()
                if held is not None:
                    ids, texts = pa.concat_arrays([held[0], ids]), [held[1], *texts]
                n = len(texts) - 1
                if n:
                    marks = [texts[0] if alone and k == 0 else None for k in range(n)]
                    yield pa.RecordBatch.from_arrays([ids.slice(0, n), pa.array([pid] * n, pa.int32()), *_judged(texts),
                                                      pa.array(marks, pa.string()), pa.nulls(n, pa.string())], ["doc_id", *_RESULT.names])
                alone = alone and not n
                held = ids.slice(n), texts[n]
        if held is not None:
            none = [pa.nulls(1, t) for t in _RESULT.types[1:6]]
            yield pa.RecordBatch.from_arrays([held[0], pa.array([pid], pa.int32()), *none,
                                              pa.array([held[1] if alone else None], pa.string()), pa.array([held[1]], pa.string())], ["doc_id", *_RESULT.names])

    # The next row's fingerprint is used up before the rows are written.
    rows = d.select("doc_id", "text").mapInArrow(each, f"doc_id {kind.simpleString()}, {_KIND}")
    rows = stored(rows.withColumn("near_next", likeness(F.col("fingerprint"), F.col("next_fingerprint"))).drop("next_fingerprint"), "print-rows")
    firsts = rows.filter("first_text IS NOT NULL").select(F.col("pid").alias("f_pid"), "first_text")
    # One row a range: pairs of neighbouring ranges, the last one's neighbour being the first.
    pids = firsts.agg(F.array_sort(F.collect_list("f_pid")).alias("pids")).select(F.posexplode("pids").alias("k", "l_pid"), "pids")
    pairs = pids.select("l_pid", F.get("pids", (F.col("k") + 1) % F.size("pids")).alias("f_pid"))
    last = rows.filter("last_text IS NOT NULL").select("doc_id", F.col("pid").alias("l_pid"), "last_text").join(pairs, "l_pid").join(firsts, "f_pid")

    def close(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                texts = [batch.column("last_text")[k].as_py(), batch.column("first_text")[k].as_py()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, 1), *_judged(texts)], ["doc_id", *_RESULT.names[1:6]])

    closed = last.select("doc_id", "last_text", "first_text").mapInArrow(close, f"doc_id {kind.simpleString()}, " + ", ".join(_KIND.split(", ")[1:6]))
    closed = closed.withColumn("near_next", likeness(F.col("fingerprint"), F.col("next_fingerprint"))).drop("next_fingerprint")
    return rows.filter("last_text IS NULL").select(*closed.columns).union(closed)


def query(docs: DataFrame) -> DataFrame:
    own, edited = F.col("fingerprint"), F.col("edited_fingerprint")
    return with_next(docs).select("doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), as_text(own).alias("fingerprint"), as_text(edited).alias("edited_fingerprint"),
                                  likeness(own, edited).alias("near_edited"), "near_next")
