"""Exact removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else too.
Suffixes are judged to that depth, so the corpus' suffix array is never built whole:

* Buckets. The suffixes whose first ``length`` bytes have the same smallest k-gram
  form one suffix bucket (equal strings always share it, at the same distance).
  Consecutive suffixes of a text mostly share it, so a bucket receives short runs
  with their bytes, not one row per suffix. Buckets with a single run are dropped
  before any text moves; equal texts and equal runs are counted, not repeated.
* Blockwise sorting. A task sorts a few buckets at a time, in bounded memory. Ranks
  of 128 bytes come from doubling 4-byte words. Suffixes that tie on their first and
  last 128 bytes are resolved by the precomputed ranks of a difference-cover sample:
  only positions in the cover modulo ``PERIOD`` carry deep ranks, and any two
  suffixes reach sample positions after the same few bytes.
* A bucket with more than ``hot`` different runs is not given to a task: its windows
  are digested to 128 bits and counted by Spark, with map-side combining.

Texts are UTF-8 bytes, null is empty; a text below ``length`` bytes loses nothing;
repeated rows are copies like any others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.llm.common import mix, range_hashes, slices, stored, text_bytes

LENGTH, GRAM, WORD, DEPTH, BATCH, HOT, PIECE = 400, 64, 4, 128, 1_800_000, 4096, 1 << 18
ORDER = 1


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """The cover of Colbourn and Ling: modulus 24r^2+36r+13 and 6r+4 residues."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate([[0], np.cumsum(steps)])


PERIOD, COVER = difference_cover(ORDER)
IN_COVER = np.zeros(PERIOD, bool)
IN_COVER[COVER] = True
#: SHIFT[i, j]: the bytes after which suffixes at residues i and j both are in the cover.
SHIFT = np.array([[next(d for d in range(PERIOD) if IN_COVER[(i + d) % PERIOD] and IN_COVER[(j + d) % PERIOD]) for j in range(PERIOD)] for i in range(PERIOD)], np.int32)


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys."""
    n = len(keys) - width + 1
    padded = np.concatenate([keys, np.full(-len(keys) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, first start, last start, position of the gram, its hash) of each run; positions in ``data``."""
    if len(data) > PIECE:  # one long text, piece by piece
        parts = []
        for at in range(0, len(data) - length + 1, PIECE):
            piece = data[at: at + PIECE + length - 1]
            d, a, b, p, h = runs(piece, np.array([0, len(piece)]), length, gram) if len(piece) <= PIECE else _runs(piece, np.array([0, len(piece)]), length, gram)
            parts.append((d, a + at, b + at, p + at, h))
        return tuple(np.concatenate(x) for x in zip(*parts))
    return _runs(data, offsets, length, gram)


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64)
    at = np.arange(len(data) - gram + 1)
    hashes = range_hashes(data, at, at + gram)
    # Leftmost smallest: 40 bits of the hash, then the position.
    keys = _window_min((hashes >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64), length - gram + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(keys)]
    valid = np.arange(len(keys)) + length <= offsets[1:][doc]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    p = (keys[a] & np.uint64((1 << 24) - 1)).astype(np.int64)
    return doc[a], a, b, p, hashes[p]


def _order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Sorted keys and their places, ties by place; None where key and place don't fit one word.

    Sorting the words themselves costs a fraction of sorting places by them. The keys, of 64 bits
    without sign, are overwritten: a task holds them once.
    """
    bits = np.uint64(max(1, len(keys).bit_length()))
    if int(keys.max(initial=0)).bit_length() + int(bits) > 64:
        return None
    keys <<= bits
    keys |= np.arange(len(keys), dtype=np.uint64)
    keys.sort()
    place = np.empty(len(keys), np.int32)
    np.bitwise_and(keys, (np.uint64(1) << bits) - np.uint64(1), out=place, casting="unsafe")
    keys >>= bits
    return keys, place


def _dense(keys: np.ndarray) -> np.ndarray:
    """Dense ranks, in 32 bits; the keys, of 64 bits without sign, are overwritten."""
    found = _order(keys)
    if found is None:
        place = np.argsort(keys)
        value = keys[place]
    else:
        value, place = found
    step = np.zeros(len(keys), np.uint32)
    step[1:] = value[1:] != value[:-1]
    np.cumsum(step, out=step)
    del value, found
    rank = np.empty(len(keys), np.uint32)
    rank[place] = step
    return rank


def _ranked(*parts: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of whole numbers without sign, in lexicographic order; all but the first are below 2^32."""
    rank = _dense(parts[0].astype(np.uint64))
    for part in parts[1:]:
        keys = rank.astype(np.uint64)
        keys *= np.uint64(int(part.max(initial=0)) + 1)
        keys += part
        rank = _dense(keys)
    return rank


def repeated(text: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which suffixes share their first ``length`` bytes with another one of their bucket.

    Every start has ``length`` bytes before the end of ``text``; DEPTH + PERIOD <= length.
    Ranks take 32 bits and keys are sorted in place, so a byte costs 25 bytes, or 35 where key and place don't fit one word.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(WORD, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range(WORD):
        word <<= np.uint64(8)
        word |= padded[k: n + k]
    rank = _dense(word)
    del padded, word
    width = WORD
    while width < DEPTH:
        keys = rank.astype(np.uint64)
        keys *= np.uint64(int(rank.max(initial=0)) + 1)
        keys[: max(0, n - width)] += rank[width:]
        rank = _dense(keys)
        del keys
        width *= 2
    # Deep ranks of the cover's positions only, to a depth that reaches the last bytes from any shift.
    deep = length - PERIOD + 1
    sample = np.flatnonzero(np.resize(IN_COVER, max(0, n - deep + 1)))
    steps = [min(k, deep - DEPTH) for k in range(0, deep, DEPTH)]
    cover = np.zeros(n, np.uint32)
    if len(sample):
        cover[sample] = _ranked(*[rank[sample + k] for k in steps])
    # Sort by bucket, first bytes and last bytes; then each tie against its leader by the cover's ranks.
    tie = _ranked(bucket, rank[starts], rank[starts + (length - DEPTH)])
    del rank
    order = _order(tie.astype(np.uint64))[1]
    out = np.zeros(len(starts), bool)
    while len(order):
        t = tie[order]
        head = np.ones(len(order), bool)
        head[1:] = t[1:] != t[:-1]
        group = np.cumsum(head, dtype=np.int32) - np.int32(1)
        i, j = starts[order], starts[order[head][group]]
        shift = SHIFT[i % PERIOD, j % PERIOD]
        same = cover[i + shift] == cover[j + shift]
        twice = np.bincount(group[same], minlength=int(group[-1]) + 1) > 1
        out[order[same & twice[group]]] = True
        order = order[~same]
    return out


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... for count[k] numbers, for every k; in 32 bits."""
    out = np.repeat((first - np.concatenate([[0], np.cumsum(count)[:-1]])).astype(np.int32), count)
    out += np.arange(len(out), dtype=np.int32)
    return out


def _stretches(flags: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last + 1) of the stretches of true flags; a row's flags lie together; positions count from the row's start."""
    cut = np.concatenate([[True], row[1:] != row[:-1]])
    begin = flags & (cut | ~np.concatenate([[False], flags[:-1]]))
    stop = flags & (np.concatenate([cut[1:], [True]]) | ~np.concatenate([flags[1:], [False]]))
    a, b, base = np.flatnonzero(begin), np.flatnonzero(stop), np.flatnonzero(cut)
    base = base[np.searchsorted(base, a, "right") - 1]
    return row[a], a - base, b - base + 1


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(t, 256)).alias("digest"), t.alias("text"))


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(documents with digest, bytes and whether the text has copies; removed stretches by digest of texts without copies)."""
    base = _texts(docs, doc_id, text)
    kind = base.schema["doc_id"].dataType.simpleString()

    def anchors(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets, PIECE):
                part = offsets[i: j + 1]
                doc, _, _, _, h = runs(data[part[0]: part[-1]], part - part[0], length)
                ends = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("digest").slice(i, j - i), pa.array(np.diff(part)), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64)))],
                                                 ["doc_id", "digest", "n_bytes", "anchors"])

    rows = stored(base.mapInArrow(anchors, f"doc_id {kind}, digest binary, n_bytes long, anchors array<long>"), "suffix-anchors")
    copies = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("one"))
    # One text of each digest goes on; a repeated row may go on twice, which changes nothing for it or others.
    single = rows.join(copies, "digest").filter(F.col("doc_id").eqNullSafe(F.col("one"))).select("digest", "copies", F.explode("anchors").alias("anchor"))
    # Written, so that the join stands alone in its stage and a hot anchor's rows can be split over tasks.
    repeats = stored(single.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "suffix-repeats")
    shared = single.join(repeats.hint("merge"), "anchor").groupBy("digest").agg(F.collect_set("anchor").alias("shared"))
    shared = shared.join(copies, "digest").select(F.col("digest").alias("s_digest"), "one", "shared")
    held = base.join(shared, (F.col("digest") == F.col("s_digest")) & F.col("doc_id").eqNullSafe(F.col("one"))).select("digest", "text", "shared")
    held = stored(held, "suffix-texts")

    def cut(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            digests, wanted = batch.column("digest").to_pylist(), batch.column("shared")
            for i, j in slices(offsets, PIECE):
                part = offsets[i: j + 1]
                piece = data[part[0]: part[-1]]
                doc, a, b, p, h = runs(piece, part - part[0], length)
                own = wanted.slice(i, j - i)
                # A run stays if its text's list has its anchor: compare (text, anchor) pairs as one hash.
                at = np.repeat(np.arange(j - i), np.diff(np.asarray(own.offsets)))
                with np.errstate(over="ignore"):
                    pair = lambda d, x: mix(x ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                    keep = np.isin(pair(doc, h), pair(at, np.asarray(own.flatten()).view(np.uint64)))
                doc, a, b, p, h = (x[keep] for x in (doc, a, b, p, h))
                raw = piece.tobytes()
                blobs = [raw[x: y + length] for x, y in zip(a.tolist(), b.tolist())]
                own_hash = [hashlib.blake2b(z + int(g).to_bytes(4, "little"), digest_size=16).digest() for z, g in zip(blobs, p - a)]
                local = a - (part[:-1] - part[0])[doc]
                for lo in range(0, len(blobs), 8192):
                    s = slice(lo, lo + 8192)
                    yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), pa.array(own_hash[s], pa.binary()), pa.array([digests[i + k] for k in doc[s]], pa.binary()), pa.array(local[s]),
                                                      pa.array((p - a)[s]), pa.array(blobs[s], pa.binary())], ["anchor", "run", "digest", "start", "ahead", "bytes"])

    cuts = stored(held.mapInArrow(cut, "anchor long, run binary, digest binary, start long, ahead long, bytes binary"), "suffix-runs")
    different = cuts.groupBy("run").agg(F.count("*").alias("n"), F.first("anchor").alias("anchor"), F.first("ahead").alias("ahead"), F.first("bytes").alias("bytes"))
    different = stored(different, "suffix-different")
    counts = stored(different.groupBy("anchor").agg(F.count("*").alias("m"), F.sum("n").alias("all")).filter("all > 1"), "suffix-buckets")
    crowded = counts.filter(F.col("m") > hot).select("anchor")
    normal = different.join(counts.filter((F.col("m") <= hot) & (F.col("m") > 1)).select("anchor").hint("merge"), "anchor").select("anchor", "run", "ahead", "bytes")
    # By a hash of the anchor: Spark leaves out a repartition by the join's own key, and a skewed join then tears buckets over tasks.
    normal = normal.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.hash("anchor")).sortWithinPartitions("anchor")

    def judged(table: pa.Table):
        """Stretches of repeated starts of the runs of whole buckets."""
        blobs = table.column("bytes").combine_chunks().cast(pa.large_binary())
        data, offsets = text_bytes(blobs)
        count = np.diff(offsets) - length + 1
        starts = _spread(offsets[:-1], count)
        row = np.repeat(np.arange(len(count), dtype=np.int32), count)
        # Bucket and distance to the gram: what stays the same along a run, less the start.
        base = np.unique(table.column("anchor").to_numpy(), return_inverse=True)[1] * (length + 1) + table.column("ahead").to_numpy() + offsets[:-1]
        bucket = base.astype(np.uint32)[row]
        bucket -= starts.view(np.uint32)
        k, a, b = _stretches(repeated(data, starts, bucket, length), row)
        return pa.RecordBatch.from_arrays([table.column("run").combine_chunks().take(pa.array(k)), pa.array(a), pa.array(b)], ["run", "a", "b"])

    def held_bytes(batch: pa.RecordBatch) -> int:
        return pc.sum(pc.binary_length(batch.column("bytes"))).as_py() or 0

    def sorted_buckets(batches):
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                waiting.append(batch.slice(lo, 256))
                size += held_bytes(waiting[-1])
                if size >= BATCH:
                    table = pa.Table.from_batches(waiting)
                    anchor = table.column("anchor").to_numpy()
                    whole = int(np.searchsorted(anchor, anchor[-1], "left"))  # the last bucket may go on
                    if whole:
                        yield judged(table.slice(0, whole))
                        waiting = table.slice(whole).combine_chunks().to_batches()
                        size = sum(map(held_bytes, waiting))
        if waiting and sum(w.num_rows for w in waiting):
            yield judged(pa.Table.from_batches(waiting))

    found = normal.mapInArrow(sorted_buckets, "run binary, a long, b long")
    whole = different.filter("n > 1").select("run", F.lit(0).cast("long").alias("a"), (F.octet_length("bytes") - length + 1).cast("long").alias("b"))

    def digested(batches):
        for batch in batches:
            for run, ahead, blob in zip(*(batch.column(c).to_pylist() for c in ("run", "ahead", "bytes"))):
                n = len(blob) - length + 1
                windows = [hashlib.blake2b(blob[k: k + length] + (ahead - k).to_bytes(4, "little", signed=True), digest_size=16).digest() for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array([run] * n, pa.binary()), pa.array(np.arange(n))], ["window", "run", "k"])

    if crowded.limit(1).count():
        rows_of = different.join(crowded, "anchor").select("run", "ahead", "bytes")
        windows = stored(rows_of.mapInArrow(digested, "window binary, run binary, k long"), "suffix-windows")
        twice = windows.groupBy("window").agg(F.count("*").alias("c")).filter("c > 1").select("window")
        found = found.unionByName(windows.join(twice, "window").select("run", F.col("k").alias("a"), (F.col("k") + 1).alias("b")))
    stretches = cuts.select("run", "digest", "start").join(found.unionByName(whole), "run").select("digest", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") - 1 + length).alias("b"))
    merged = stretches.groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans")).withColumnRenamed("digest", "m_digest")

    def kept(batches):
        for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            out = []
            for digest, text, spans in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw, joined = text.encode(), []
                for s in spans:
                    if joined and s["a"] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], s["b"])
                    else:
                        joined.append([s["a"], s["b"]])
                sha, upto = hashlib.sha256(), 0
                for a, b in joined:
                    sha.update(raw[upto:a])
                    upto = b
                sha.update(raw[upto:])
                out.append((digest, sum(b - a for a, b in joined), len(joined), sha.hexdigest(), [{"a": a, "b": b} for a, b in joined]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))])],
                                             ["k_digest", "removed", "spans_n", "kept", "spans"])

    taken = held.select("digest", "text").join(merged, F.col("digest") == F.col("m_digest")).select("digest", "text", "spans")
    taken = taken.mapInArrow(kept, "k_digest binary, removed long, spans_n long, kept string, spans array<struct<a:long,b:long>>").dropDuplicates(["k_digest"])
    return rows.select("doc_id", "digest", "n_bytes").join(copies.select(F.col("digest").alias("c_digest"), "copies"), F.col("digest") == F.col("c_digest")).drop("c_digest"), taken


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans."""
    rows, taken = removals(docs, doc_id, text, length, hot)
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = rows.join(taken, F.col("digest") == F.col("k_digest"), "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n_bytes").alias("b")))
    return out.select("doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
                      F.when(gone, 1).otherwise(F.coalesce("spans_n", F.lit(0))).cast("long").alias("n_spans"),
                      F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", F.lower(F.hex("digest")))).alias("kept_sha256"),
                      F.when(gone, whole).otherwise(F.col("spans")).alias("spans"))


def query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
