"""MinHash near-duplicates with odd sketches.

A document is the set of its distinct word shingles (words as runs of characters
other than ASCII white space, A-Z folded), held as 64-bit hashes. Documents with
equal sets are one class from the start, so copies cost no comparison.

MinHash samples give ``BANDS`` keys of ``ROWS`` samples; two sets of Jaccard 0.85
share no key with probability below 1e-7, of 0.80 below 2e-5. Classes that share keys, directly or
through others, form a cluster, found by label propagation over one star per key, each class
being sent to the least of its stars' hubs and hubs to each other;
no bucket is ever gathered or expanded into pairs. Within a cluster every pair is
judged: each sample is folded into a parity bitmap of ``BITS`` bits, the XOR
population count of two bitmaps bounds how many samples differ, pairs beyond
``far_limit`` (six deviations past the threshold) are dropped, and the rest are
confirmed on their full sets by counting shared shingles. A cluster above the
block limits is cut into blocks and every pair of blocks is one task, so no task
holds more than two blocks; a task passes on a spanning forest, not its links.

Documents without words have the empty set, link with nothing and are kept.
Repeated rows are copies of each other; a null id never is a component's id if
some member has one. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.llm.common import FOLD, hashed_words, mix, slices, stored, text_bytes

SHINGLE, ROWS, BANDS, BITS = 3, 5, 28, 512
SAMPLES = ROWS * BANDS
#: A block holds at most so many members and shingles.
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 1024, 1_500_000, 4096
_rng = np.random.default_rng(5)
_FACTORS = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, and n + 1 offsets."""
    words, bounds = hashed_words(FOLD[data], offsets)
    n = np.diff(bounds)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    first = bounds[:-1][doc] + np.arange(ends[-1]) - ends[:-1][doc]
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    h = np.zeros(len(first), np.uint64)
    last = bounds[1:][doc]
    with np.errstate(over="ignore"):
        for k in range(size):
            h = mix(h * np.uint64(0xD1342543DE82EF95) + np.where(first + k < last, padded[first + k], np.uint64(k)))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n)))])


def signatures(sets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (documents x BANDS) and odd sketches (documents x BITS / 64) of non-empty sets."""
    n = len(ends) - 1
    low = np.empty((n, SAMPLES), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SAMPLES):
            low[:, k] = np.minimum.reduceat(sets * _FACTORS[k] + _SHIFTS[k], ends[:-1])
        keys = np.zeros((n, BANDS), np.uint64)
        for r in range(ROWS):
            keys = mix(keys * np.uint64(0xD1342543DE82EF95) + low[:, r::ROWS])
        keys = mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        bit = mix(low + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(BITS)
    sketch = np.zeros((n, BITS // 64), np.uint64)
    doc = np.arange(n)
    for k in range(SAMPLES):
        sketch[doc, bit[:, k] >> np.uint64(6)] ^= np.uint64(1) << (bit[:, k] & np.uint64(63))
    return keys, sketch


def _class(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit key per set; equal sets have equal keys."""
    n = np.diff(ends)
    with np.errstate(over="ignore"):
        both = mix(np.add.reduceat(mix(sets), ends[:-1]) ^ (np.bitwise_xor.reduceat(mix(sets + np.uint64(1)), ends[:-1]) * np.uint64(0x9E3779B97F4A7C15)) + n.astype(np.uint64))
    return both.view(np.int64)


def _some(sets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the non-empty sets, and their offsets."""
    has = np.flatnonzero(np.diff(ends) > 0)
    return has, np.append(ends[:-1][has], ends[-1])


def signed(docs: DataFrame, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, c, bands): set size, class key (null for empty sets) and band keys, given once per class and task."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def each(batches):
        seen: set[int] = set()
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                part = offsets[i: j + 1]
                sets, ends = shingle_sets(data[part[0]: part[-1]], part - part[0], size)
                has, own = _some(sets, ends)
                c, bands, n = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64), np.diff(ends)
                keys = np.zeros(0, np.uint64)
                if len(has):
                    c[has] = _class(sets, own)
                    fresh = np.array([k for k, x in enumerate(c[has].tolist()) if x not in seen and not seen.add(x)], np.int64)
                    if len(fresh):
                        chosen = [sets[own[k]: own[k + 1]] for k in fresh]
                        keys = signatures(np.concatenate(chosen), np.concatenate([[0], np.cumsum([len(x) for x in chosen])]))[0].ravel()
                        bands[has[fresh]] = BANDS
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(bands)]).astype(np.int32), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(c, mask=n == 0), lists], ["doc_id", "n", "c", "bands"])

    return d.mapInArrow(each, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n long, c long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable over undirected edges (a, b), by label propagation with jumps."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "near-edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("label")), "near-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        new = stored(labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label")), "near-labels")
        # Every label is an id, so its own label can be taken at once.
        jump = new.select(F.col("id").alias("label"), F.col("label").alias("next"))
        labels = stored(new.join(jump, "label").select("id", "old", F.least("label", "next").alias("label")), "near-labels")
        if not labels.filter("label < old").limit(1).count():
            return labels.select("id", "label")
        labels = labels.drop("old")


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what ``edges`` connect: each b with its least a, and the distinct pairs of that one and b's other a.

    Many b share few a here, so members times hubs become members plus pairs of hubs.
    """
    least = edges.groupBy("b").agg(F.min("a").alias("low"))
    pairs = edges.join(least.withColumnRenamed("b", "l_b"), F.col("b") == F.col("l_b")).filter("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b")).distinct()
    return least.select(F.col("low").alias("a"), "b").union(pairs)


def far_limit(percent: int) -> int:
    """The most bits two bitmaps differ in at this Jaccard: the mean of differing samples and six deviations, two bits each."""
    apart = 1 - percent / 100
    return int(np.ceil(2 * (SAMPLES * apart + 6 * np.sqrt(SAMPLES * apart * (1 - apart)))))


def _links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The smallest index that each set is linked with over pairs of at least ``percent`` Jaccard."""
    m = len(sets)
    n = np.array([len(s) for s in sets])
    flat, ends = np.concatenate(sets), np.concatenate([[0], np.cumsum(n)])
    sketch = signatures(flat, ends)[1]
    near = np.zeros((m, m), bool)
    for i in range(m):
        far = np.bitwise_count(sketch[i] ^ sketch[i + 1:]).sum(1, dtype=np.int32)
        near[i, i + 1:] = (far <= far_limit(percent)) & (100 * np.minimum(n[i], n[i + 1:]) >= percent * np.maximum(n[i], n[i + 1:]))
    label = np.arange(m)
    used = np.flatnonzero(near.any(0) | near.any(1))
    if not len(used):
        return label
    near = near[np.ix_(used, used)]
    value, column, count = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), n[used])
    shared = count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    common = np.zeros((len(used), len(used)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        x = np.zeros((len(used), COLUMNS), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        common += x @ x.T
    common = common.astype(np.int64)
    union = n[used][:, None] + n[used][None, :] - common
    linked = near & (100 * common >= percent * union)
    linked |= linked.T
    np.fill_diagonal(linked, True)
    own = np.arange(len(used))
    while True:
        low = np.where(linked, own[None, :], len(used)).min(1)
        low = np.minimum(low, own[low])
        if (low == own).all():
            break
        own = low
    label[used] = used[own]
    return label


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; links need ``percent`` (80 or more) Jaccard."""
    sigs = stored(signed(docs, size, doc_id, text), "near-signatures")
    classes = sigs.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("m"), F.max("n").alias("n"))
    bands = sigs.filter("n > 0").select("c", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("z")).filter("a < z").select("key", "a")
    # Neither side has a size bound: merged at every size, so small and large inputs take the same plan.
    stars = bands.join(shared.hint("merge"), "key").filter("c <> a").groupBy("c").agg(F.array_sort(F.collect_set("a")).alias("hubs"))
    # A class has BANDS hubs at most: it goes to the least, and the hubs are linked among themselves once for all that share them.
    hubs = stars.select(F.explode(F.slice("hubs", 2, BANDS)).alias("b"), F.get("hubs", F.lit(0)).alias("a")).distinct()
    clusters = components(stars.select(F.get("hubs", F.lit(0)).alias("a"), F.col("c").alias("b")).union(hubs.select("a", "b"))).select(F.col("id").alias("c"), F.col("label").alias("cluster"))
    members = stored(clusters.join(classes, "c"), "near-members")
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # One text per class is read, with its place; its set is made after the join, so no set is shuffled twice.
    wanted = members.select(F.col("m").alias("w_id"), "c", "cluster").join(sizes, "cluster")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    placed = texts.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("w_id"))).select("text", "c", "cluster", "blocks")

    def full(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                part = offsets[i: j + 1]
                sets, ends = shingle_sets(data[part[0]: part[-1]], part - part[0], size)
                has, own = _some(sets, ends)
                if len(has):
                    # Rows may repeat an id with another text: a place belongs to the text of its class.
                    right = np.flatnonzero(_class(sets, own) == batch.column("c").slice(i, j - i).to_numpy()[has])
                    place = batch.select(["c", "cluster", "blocks"]).slice(i, j - i).take(pa.array(has[right]))
                    blobs = pa.array([sets[own[k]: own[k + 1]].tobytes() for k in right], pa.binary())
                    yield pa.RecordBatch.from_arrays([*place.columns, blobs], ["c", "cluster", "blocks", "shingles"])

    dealt = placed.mapInArrow(full, "c long, cluster long, blocks int, shingles binary")
    # A member of block k meets every block: it goes to the tasks (i, k) for i up to k and (k, j) for j beyond.
    own = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).select("c", "shingles", "cluster", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("c", "shingles", "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def judged(table: pa.Table) -> pa.Table:
        keys, at = np.unique(table.column("c").to_numpy(), return_index=True)
        blobs = table.column("shingles").combine_chunks()
        label = _links([np.frombuffer(blobs[int(i)].as_buffer(), np.uint64) for i in at], percent)
        out = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": keys[label[out]], "b": keys[out]})

    links = stored(dealt.groupBy("cluster", "i", "j").applyInArrow(judged, "a long, b long"), "near-links")
    linked = components(thinned(links))
    least = linked.join(members, F.col("id") == F.col("c")).groupBy("label").agg(F.min("m").alias("least"))
    least = linked.join(least, "label").select(F.col("id").alias("l_c"), "least")
    named = classes.join(least, F.col("c") == F.col("l_c"), "left").select(F.col("c").alias("n_c"), F.coalesce("least", "m").alias("component"))
    out = sigs.drop("bands").join(named, F.col("c") == F.col("n_c"), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, size=SHINGLE, percent=85)
