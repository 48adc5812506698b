"""Runs of periodic words, found by block convolution.

A run is a stretch of consecutive words with smallest period q, at least
``min_length`` words and ``min_repeats`` periods long, that no neighbouring word
extends keeping period q. Words are runs of characters other than ASCII white space.

At each dyadic scale B the words are cut into blocks of B. A run of period q with
B <= q < 2B holds a whole block that comes again q words later, so every block is
held against the shifts B to 2B - 1 of the window that follows (the least scale
takes all smaller shifts too): words become small codes, the sum of squared
differences at every shift comes from one number-theoretic transform, and the sums
stay below the modulus, so zero means equal codes. Blocks with a word that does
not come again within the window cannot match and are not transformed. Matches of
neighbouring blocks at one distance are one seed; seeds are extended both ways by
comparing hashes of ranges, and every accepted run is compared word by word (if a
hash was wrong, all seeds of that slice are extended word by word instead). Of
equal stretches the smallest distance is the period, all smaller periods having
been found at the scales before.

Work on n words is of the order n log(n)^2, memory follows the longest text of a
task (a few dozen bytes a word). A null text has no words. Repeated rows and ids
are judged each; texts without runs come back as their words joined by one space;
columns other than the id and the text are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasemill.llm.common import hashed_words, mix, slices, text_bytes, word_spans

MIN_LENGTH, MIN_REPEATS = 24, 3
#: A prime 119 * 2^23 + 1 with primitive root 3.
PRIME, ROOT = 998244353, 3
_P = np.uint64(PRIME)
#: Numbers that one transform step holds.
CELLS = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def _twiddles(size: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of unity of this order."""
    root = pow(ROOT, (PRIME - 1) // size, PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    out = np.ones(size // 2, np.uint64)
    done = 1
    while done < len(out):
        more = min(done, len(out) - done)
        out[done: done + more] = out[:more] * np.uint64(pow(root, done, PRIME)) % _P
        done += more
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """The transform of every row modulo the prime, in bit-reversed order; the width is a power of two."""
    m, n = rows.shape
    half = n // 2
    while half:
        x = rows.reshape(m, -1, 2, half)
        u, v = x[:, :, 0], x[:, :, 1]
        both = u + v
        rows = np.stack([np.minimum(both, both - _P), (u + _P - v) * _twiddles(2 * half, False) % _P], axis=2)
        half //= 2
    return rows.reshape(m, n)


def restore(rows: np.ndarray) -> np.ndarray:
    """The inverse of ``transform``."""
    m, n = rows.shape
    half = 1
    while half < n:
        x = rows.reshape(m, -1, 2, half)
        u, v = x[:, :, 0], x[:, :, 1] * _twiddles(2 * half, True) % _P
        up, down = u + v, u + _P - v
        rows = np.stack([np.minimum(up, up - _P), np.minimum(down, down - _P)], axis=2)
        half *= 2
    return rows.reshape(m, n) * np.uint64(pow(n, -1, PRIME)) % _P


def shift_distances(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sum of squared differences of each block and its window at every shift, exact while it stays below the prime."""
    m, size = blocks.shape
    wide = windows.shape[1]
    n = 1 << (wide - 1).bit_length()
    a, b = np.zeros((m, n), np.uint64), np.zeros((m, n), np.uint64)
    a[:, :size], b[:, :wide] = blocks[:, ::-1], windows
    products = restore(transform(a) * transform(b) % _P)[:, size - 1: wide]
    squares = np.cumsum(np.concatenate([np.zeros((m, 1), np.uint64), windows * windows], axis=1), axis=1)
    own = (blocks * blocks).sum(1, dtype=np.uint64)
    return (own[:, None] + squares[:, size:] - squares[:, : wide - size + 1]).astype(np.int64) - 2 * products.astype(np.int64)


def least_block(min_length: int, min_repeats: int) -> int:
    """The largest block, a power of two, of which every run of a period below twice its size holds a repeated one."""
    fits = lambda b: all(max(min_length, min_repeats * q) >= 2 * b - 1 + q for q in range(1, 2 * b))
    return max(b for b in (1, 2, 4, 8, 16, 32, 64) if fits(b))


def _seeds(words: np.ndarray, longest: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of block matches, one for each chain of neighbouring blocks."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    again = np.full(n, n, np.int64)
    same = words[order[1:]] == words[order[:-1]]
    again[order[:-1][same]] = np.diff(order)[same]
    places, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size, farthest = least, again
    farthest = farthest[: n // size * size].reshape(-1, size).max(1)
    while size == least or 3 * size <= longest:
        first, count = (1, 2 * size - 1) if size == least else (size, size)
        bound = min(256, int(np.sqrt(PRIME // size)))
        codes = np.concatenate([mix(words.astype(np.uint64)) % np.uint64(bound), np.zeros(4 * size, np.uint64)])
        at = np.flatnonzero(farthest < first + count) * size
        wide = count + size - 1
        step = max(1, CELLS // (4 * size))
        x, d = [], []
        for i in range(0, len(at), step):
            some = at[i: i + step, None]
            zero = shift_distances(codes[some + np.arange(size)], codes[some + first + np.arange(wide)]) == 0
            row, shift = np.nonzero(zero)
            x.append(some[row, 0])
            d.append(first + shift)
        x, d = np.concatenate([*x, places[0]]), np.concatenate([*d, distances[0]])
        inside = x + d + size <= n
        x, d = x[inside], d[inside]
        order = np.lexsort((x, d))
        x, d = x[order], d[order]
        head = np.ones(len(x), bool)
        head[1:] = (d[1:] != d[:-1]) | (x[1:] - x[:-1] != size)
        places.append(x[head])
        distances.append(d[head])
        size *= 2
        farthest = farthest[: len(farthest) // 2 * 2].reshape(-1, 2).max(1)
    return np.concatenate(places), np.concatenate(distances)


def _reach(equal, most: np.ndarray) -> np.ndarray:
    """The largest length up to ``most`` for which ``equal`` holds, by bisection."""
    low, high = np.zeros(len(most), np.int64), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        good = equal(middle)
        low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
    return low


def _extended(words: np.ndarray, x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretch of period d around each place, by hashes of ranges."""
    n = len(words)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]))
        run = np.concatenate([[np.uint64(0)], np.cumsum(mix(words.astype(np.uint64)) * power[:n], dtype=np.uint64)])
        scale = power[d]
        ahead = _reach(lambda k: (run[x + k] - run[x]) * scale == run[x + d + k] - run[x + d], n - x - d)
        back = _reach(lambda k: (run[x] - run[x - k]) * scale == run[x + d] - run[x + d - k], x)
    return x - back, x + d + ahead


def _scanned(words: np.ndarray, x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, word by word."""
    start, end = x.copy(), x + d
    for i, (at, q) in enumerate(zip(x.tolist(), d.tolist())):
        differ = np.flatnonzero(words[:-q] != words[q:])
        j = np.searchsorted(differ, at)
        start[i] = differ[j - 1] + 1 if j else 0
        end[i] = (differ[j] if j < len(differ) else len(words) - q) + q
    return start, end


def find_runs(words: np.ndarray, longest: int | None = None, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """(start, length, period) of all runs of a sequence of word numbers, by start and period."""
    if min_repeats < 3:
        raise ValueError("a run has three periods at least")
    if len(words) < min_length:
        return np.zeros((0, 3), np.int64)
    x, d = _seeds(words, len(words) if longest is None else longest, least_block(min_length, min_repeats))
    for extend in (_extended, _scanned):
        start, end = extend(words, x, d)
        good = end - start >= np.maximum(min_length, min_repeats * d)
        found = np.stack([start[good], end[good], d[good]], axis=1)
        found = found[np.lexsort(found.T[::-1])]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
        found = found[new]
        if all(np.array_equal(words[s: e - q], words[s + q: e]) for s, e, q in found.tolist()):
            break
    return np.stack([found[:, 0], found[:, 1] - found[:, 0], found[:, 2]], axis=1)


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of each text by start and period, and its words joined by one space
    without those that some run contains after its first period."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def each(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                part = offsets[i: j + 1] - offsets[i]
                raw = data[offsets[i]: offsets[j]]
                starts, ends = word_spans(raw, part)
                hashes, bounds = hashed_words(raw, part)
                # No word number occurs in two documents, so nothing matches across them.
                doc = np.repeat(np.arange(j - i), np.diff(bounds))
                _, number = np.unique(hashes, return_inverse=True)
                _, number = np.unique(number * (j - i) + doc, return_inverse=True)
                runs = find_runs(number, int(np.diff(bounds).max(initial=0)), min_length, min_repeats)
                edge = np.zeros(len(number) + 1, np.int64)
                np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
                np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
                kept = np.cumsum(edge[:-1]) == 0
                whole = raw.tobytes()
                collapsed = []
                for k in range(j - i):
                    own = np.flatnonzero(kept[bounds[k]: bounds[k + 1]]) + bounds[k]
                    collapsed.append(b" ".join([whole[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist())]))
                owner = doc[runs[:, 0]]
                table = pa.StructArray.from_arrays([pa.array(runs[:, 0] - bounds[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32), table)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(bounds).astype(np.int64)), lists, pa.array(collapsed, pa.string())],
                                                 ["doc_id", "n_words", "runs", "collapsed"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(each, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(text: Column, doc_id: Column) -> Column:
    """The text in which the contract makes the words of every tenth document periodic from some word on; a null id counts as ''."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.concat_ws(" ", F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n))).otherwise(text)


def query(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    found = periodic_runs(docs.select("doc_id", planted(text, F.col("doc_id")).alias("text")))
    # Runs come by start and period, so only a strictly better one replaces the first.
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, run: F.when(better(best, run), run).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
