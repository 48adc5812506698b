"""Language-model scores by context-tree weighting over bytes.

A text is its bytes with A-Z in lower case, then an end mark (a byte that UTF-8 never
holds), so the probabilities of all texts add up to one. A byte is eight binary
decisions under the context of the bytes before it. Each (context, decision) node has
a Krichevsky-Trofimov estimate from the training texts; at every depth from 0 to 3 the
node's own estimate and that of the deeper contexts are mixed with weight one half
each, so all depths are weighted by how well they coded the training bytes; a deeper
context that was never seen says one half and is mixed in like any other. A text starts
in the context of three zero bytes. The score of a text is the log10 probability of its
bytes and its end, the code length per byte follows from it.

Every context of depth 3 that the training texts hold has a node of its own. Those
are summed up by the two nearest bytes in Spark, so the driver weighs depths 0 to 2
(at most 65,536 contexts). Tasks get a table of bounded size (under 100 MB): the
contexts of depth 3 that cover at least a 2^-15 share of the training bytes (so
32,768 at most), and what is said under contexts that were never seen. Bytes under
the other contexts are joined with the probabilities of exactly those strings that
occur, made group by group from the counts; that join sends its smaller side only
behind a count.

Beside it stands the unigram base score. Token counts are exact for the whole
corpus: tokens are 64-bit hashes of words; the most frequent tokens (``HEAD`` at
most, by a threshold from the histogram of counts) are sent to the tasks, all
others are joined by shuffle; no one of them is frequent, so no key is hot.

Null and empty texts are one end token and score the end mark alone. Repeated rows
give repeated rows. Without training texts counts are zero and the tree gives 8 bits
to a byte and to the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.llm.common import FOLD, hashed_words, remainder, slices, stored, text_bytes
from phasemill.operators.sizing import small

DEPTH, SHARE, HEAD = 3, 1 << 15, 1 << 18
#: Distinct keys that a task holds before it passes their counts on.
HELD = 1 << 20
#: Rows of a table that is sent to the tasks.
SENT = 500_000
#: The end of a text as a token; a word hash equals it with probability 2^-64.
END = 1
#: The end of a text in the tree, and contexts whose estimates are made at a time.
END_BYTE, BLOCK = 0xFF, 4096


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)


class _Counter:
    """Counts of integer keys, merged as they come in."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, values: np.ndarray) -> None:
        k, c = np.unique(values, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.size += len(k)
        if self.size > HELD:
            k, c = _merged(self.keys, self.counts)
            self.keys, self.counts, self.size = [k], [c], len(k)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = _merged(self.keys, self.counts) if self.keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.keys, self.counts, self.size = [], [], 0
        return out


def with_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in lower case with the end mark after each, and their offsets."""
    return np.insert(FOLD[data], offsets[1:], np.uint8(END_BYTE)), offsets + np.arange(len(offsets))


def context_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per byte: the three bytes before it in its text (zeros at the start) and itself, as 32 bits."""
    b = data.astype(np.uint32)
    code = b.copy()
    position = np.arange(len(b)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, DEPTH + 1):
        before = np.zeros(len(b), np.uint32)
        before[k:] = b[:-k] if k < len(b) else before[k:]
        before[position < k] = 0
        code |= before << np.uint32(8 * k)
    return code


def corpus_counts(train: DataFrame, text: str = "text") -> DataFrame:
    """(kind, key, n): exact counts of tokens (kind 0) and of 4-byte strings with their context (kind 1)."""

    def each(batches):
        counters = (_Counter(), _Counter())

        def out(kind):
            k, c = counters[kind].take()
            if kind == 0:  # a token of the largest hashes keeps its bits
                k = k.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.astype(np.int64)), pa.array(c)], ["kind", "key", "n"])

        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in slices(offsets):
                part = offsets[i: j + 1]
                piece, part = data[part[0]: part[-1]], part - part[0]
                words, _ = hashed_words(FOLD[piece], part)
                counters[0].add(np.concatenate([words, np.full(j - i, END, np.uint64)]))
                counters[1].add(context_codes(*with_ends(piece, part)))
            for kind in (0, 1):
                if counters[kind].size > HELD // 2:
                    yield out(kind)
        yield out(0)
        yield out(1)

    rows = train.select(F.col(text).cast("string").alias("text")).mapInArrow(each, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 6."""
    shift = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4) * (x + 5))
    z = x + 6
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _nodes(counts: np.ndarray) -> np.ndarray:
    """Counts of the 511 nodes of the binary decomposition from counts of the 256 bytes."""
    tree = np.zeros((len(counts), 512))
    tree[:, 256:] = counts
    for level in range(7, -1, -1):
        lo = 1 << level
        tree[:, lo: 2 * lo] = tree[:, 2 * lo: 4 * lo: 2] + tree[:, 2 * lo + 1: 4 * lo: 2]
    return tree


def _estimates(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per context and decision node: log KT probability of the decisions seen, and that the next is 1."""
    tree = _nodes(counts)
    zeros, ones = tree[:, 2:512:2], tree[:, 3:512:2]  # of node n: at n - 1
    block = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)
    return block, (ones + 0.5) / (zeros + ones + 1)


def _rows(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of some codes, rising, and the counts of the 256 bytes under each."""
    contexts, at = np.unique(codes >> 8, return_inverse=True)
    return contexts, np.bincount(at * 256 + (codes & 0xFF), weights=counts, minlength=len(contexts) * 256).reshape(-1, 256)


def _seconds(contexts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per context of depth 2: its id, counts of bytes, log KT probabilities of its deeper contexts, and which bytes before it were seen."""
    ids, at = np.unique(contexts & 0xFFFF, return_inverse=True)
    sums, logs, seen = np.zeros((len(ids), 256)), np.zeros((len(ids), 255)), np.zeros((len(ids), 256), bool)
    for lo in range(0, len(contexts), BLOCK):
        some = slice(lo, lo + BLOCK)
        np.add.at(sums, at[some], counts[some])
        np.add.at(logs, at[some], _estimates(counts[some])[0])
    seen[at, contexts >> 16] = True
    return ids, sums, logs, np.packbits(seen, axis=1)


class Upper:
    """Depths 0 to 2: what turns the estimate of a context of depth 3 into the weighted probability."""

    def __init__(self, second: np.ndarray, sums: np.ndarray, deeper: np.ndarray):
        self.second, self.first = second, np.unique(second & 0xFF)
        self.parents = [np.searchsorted(self.first, second & 0xFF), np.zeros(len(self.first), np.int64)]
        self.ratios, self.chances = [], []
        counted = sums
        for depth in (2, 1, 0):
            n_up = len(self.first) if depth == 2 else 1
            chance, ratio = np.empty((len(counted), 255), np.float32), np.empty((len(counted), 255), np.float32)
            mixed, up = np.zeros((n_up, 255)), np.zeros((n_up, 256))
            # Bottom up: how well a node's own estimate coded its bytes against its deeper contexts.
            for lo in range(0, len(counted), BLOCK):
                at = slice(lo, lo + BLOCK)
                own_log, chance[at] = _estimates(counted[at])
                ratio[at] = np.exp(np.clip(own_log - deeper[at], -80, 80))
                if depth:
                    np.add.at(mixed, self.parents[2 - depth][at], np.logaddexp(own_log, deeper[at]) - np.log(2))
                    np.add.at(up, self.parents[2 - depth][at], counted[at])
            self.ratios.append(ratio)
            self.chances.append(chance)
            counted, deeper = up, mixed

    def weighted(self, p, at: np.ndarray, depth: int = 2) -> np.ndarray:
        """From estimates below the contexts ``at`` of ``depth`` up to the root."""
        for d in range(depth, -1, -1):
            ratio, chance = self.ratios[2 - d][at], self.chances[2 - d][at]
            p = (ratio * chance + p) / (ratio + 1)
            at = self.parents[2 - d][at] if d else at
        return p


class Tree:
    """Log10 probabilities of the next byte, one row per deepest context that tasks get.

    ``codes`` are context bytes (the nearest lowest) and the byte itself. ``second`` sums
    up all contexts by the two nearest bytes, as ``_seconds`` does; without it the codes are all there are.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, second: tuple[np.ndarray, ...] | None = None):
        self.expanded, deep = _rows(codes, counts)
        self.second, sums, logs, self.seen = second or _seconds(self.expanded, deep)
        self.upper = Upper(self.second, sums, logs)
        self.first = self.upper.first
        n_own, n_second = len(self.expanded), len(self.second)
        self.n_rows, self.unknown = n_own + n_second, n_own + n_second + len(self.first)
        self.table = np.empty((self.unknown + 1, 256), np.float32)
        parents = np.searchsorted(self.second, self.expanded & 0xFFFF)
        for lo in range(0, n_own, BLOCK):
            at = slice(lo, min(n_own, lo + BLOCK))
            self.table[at] = self._bytes(self.upper.weighted(_estimates(deep[at])[1].astype(np.float32), parents[at]))
        # Contexts of which only the two last bytes are known, the last, and nothing: what was never seen says one half.
        half = np.float32(0.5)
        for lo in range(0, n_second, BLOCK):
            at = np.arange(lo, min(n_second, lo + BLOCK))
            self.table[n_own + at] = self._bytes(self.upper.weighted(half, at))
        self.table[self.n_rows: self.unknown] = self._bytes(self.upper.weighted(half, np.arange(len(self.first)), 1))
        self.table[self.unknown] = self._bytes(self.upper.weighted(half, np.zeros(1, np.int64), 0))[0]

    @staticmethod
    def _bytes(p: np.ndarray) -> np.ndarray:
        one, zero = np.log10(p), np.log10(1 - p)
        out = np.zeros((len(p), 256))
        byte = np.arange(256)
        for level in range(8):
            node = (256 + byte) >> (8 - level)
            out += np.where((byte >> (7 - level)) & 1, one[:, node - 1], zero[:, node - 1])
        return out

    def rows(self) -> np.ndarray:
        """Three context bytes -> row of the table, as one array of 2^24 entries; -1 for contexts that were seen and have no row."""
        first = np.full(256, self.unknown, np.int32)
        first[self.first] = self.n_rows + np.arange(len(self.first))
        second = np.tile(first, 256)
        second[self.second] = len(self.expanded) + np.arange(len(self.second))
        out = np.tile(second, 256)
        for third in range(256):
            out[(third << 16) + self.second[(self.seen[:, third >> 3] >> (7 - (third & 7))) & 1 == 1]] = -1
        out[self.expanded] = np.arange(len(self.expanded))
        return out

    def parts(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log10 probability of each text without the bytes under contexts that have no row, the codes of those bytes, and n + 1 offsets of them."""
        if not len(data):
            return np.zeros(len(offsets) - 1), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        code = context_codes(data, offsets).astype(np.int64)
        row = rows[code >> 8]
        out = row < 0
        each = np.where(out, np.float32(0), self.table.ravel()[np.maximum(row, 0).astype(np.int64) * 256 + (code & 0xFF)])
        run = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
        return run[offsets[1:]] - run[offsets[:-1]], code[out], np.concatenate([[0], np.cumsum(out)])[offsets]

    def log10(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Log10 probability of each text, where every seen context has a row."""
        return self.parts(data, offsets, rows)[0]


def _summed_up(table: pa.Table) -> pa.Table:
    """One context of depth 2 (at most 65,536 codes) as ``_seconds`` tells it."""
    ids, sums, logs, seen = _seconds(*_rows(table.column("key").to_numpy(), table.column("n").to_numpy()))
    return pa.table({"second": ids, "sums": list(sums), "logs": list(logs), "seen": [x.tobytes() for x in seen]})


class Model:
    def __init__(self, counts: DataFrame):
        self.counts = counts
        self.grams = counts.filter("kind = 1").select("key", F.shiftright("key", 8).alias("context"), F.shiftright("key", 8).bitwiseAND(0xFFFF).alias("second"), "n")
        grams = self.grams
        weights = grams.groupBy("context").agg(F.sum("n").alias("w"))
        total = weights.agg(F.sum("w")).first()[0] or 0
        own = weights.filter(F.col("w") * SHARE >= total).select("context")
        # At most 2^15 contexts get a row in the tasks' table, so that side is small enough to send.
        head = grams.join(F.broadcast(own), "context").select("key", "n").toPandas()
        # At most 2^16 rows.
        second = grams.select("second", "key", "n").groupBy("second").applyInArrow(_summed_up, "second long, sums array<double>, logs array<double>, seen binary").orderBy("second").toPandas()
        stacked = lambda c, n: np.stack(second[c].to_numpy()) if len(second) else np.zeros((0, n))
        seen = np.frombuffer(b"".join(second["seen"]), np.uint8).reshape(-1, 32)
        self.tree = Tree(head["key"].to_numpy(np.int64), head["n"].to_numpy(np.int64), (second["second"].to_numpy(np.int64), stacked("sums", 256), stacked("logs", 255), seen))
        self.upper, self.tree.upper = self.tree.upper, None  # tasks that read texts need the table alone
        tokens = counts.filter("kind = 0")
        sizes = tokens.groupBy(F.floor(F.log2("n")).alias("size")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).orderBy(F.desc("size")).collect()
        self.vocabulary, self.tokens = sum(r["v"] for r in sizes), sum(r["n"] for r in sizes)
        taken, self.least = 0, None
        for r in sizes:
            if taken + r["v"] > HEAD:
                break
            taken, self.least = taken + r["v"], 1 << r["size"]
        head = tokens.filter(F.col("n") >= self.least).select("key", "n").toPandas() if self.least else None
        keys = head["key"].to_numpy(np.int64).view(np.uint64) if head is not None else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.head = keys[order], (head["n"].to_numpy(np.int64)[order] if head is not None else np.zeros(0, np.int64))


def fit(train: DataFrame, text: str = "text") -> Model:
    return Model(stored(corpus_counts(train, text), "lm-counts"))


def _log_chances(asked: DataFrame, model: Model) -> DataFrame:
    """(key, p): log10 probabilities of the codes asked for, from the counts of their contexts."""
    sent = asked.sparkSession.sparkContext.broadcast(model.upper)

    def each(wanted: pa.Table, counted: pa.Table) -> pa.Table:
        upper, codes = sent.value, wanted.column("key").to_numpy()
        contexts, counts = _rows(counted.column("key").to_numpy(), counted.column("n").to_numpy())
        mine = np.isin(contexts, codes >> 8)
        contexts, counts = contexts[mine], counts[mine]
        at = np.searchsorted(upper.second, contexts & 0xFFFF)
        table = Tree._bytes(upper.weighted(_estimates(counts)[1].astype(np.float32), at))
        return pa.table({"key": codes, "p": table[np.searchsorted(contexts, codes >> 8), codes & 0xFF]})

    asked = asked.select("key", F.shiftright("key", 8).bitwiseAND(0xFFFF).alias("second"))
    # A context of depth 2 has at most 65,536 codes on either side.
    counted = model.grams.select("key", "second", "n").join(asked.select("second").distinct(), "second", "left_semi")
    return asked.groupBy("second").cogroup(counted.groupBy("second")).applyInArrow(each, "key long, p double")


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: tokens, known tokens, corpus tokens, base score, tree score and bits per byte."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    floor = model.tokens + 0.1 * (model.vocabulary + 1)
    sent = docs.sparkSession.sparkContext.broadcast((model.tree, model.head))

    def each(batches):
        tree, (keys, counts) = sent.value
        rows = tree.rows()
        logs = np.log10((np.append(counts, 0) + 0.1) / floor)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                part = offsets[i: j + 1]
                piece, part = data[part[0]: part[-1]], part - part[0]
                words, bounds = hashed_words(FOLD[piece], part)
                words = np.insert(words, bounds[1:], np.uint64(END))
                bounds = bounds + np.arange(len(bounds))
                at = np.searchsorted(keys, words)
                known = np.zeros(len(words), bool)
                inside = at < len(keys)
                known[inside] = keys[at[inside]] == words[inside]
                sums = np.add.reduceat(np.where(known, logs[np.minimum(at, len(keys))], 0.0), bounds[:-1])
                n_known = np.add.reduceat(known.astype(np.int64), bounds[:-1])
                rest = words[~known].view(np.int64)
                ends = np.concatenate([[0], np.cumsum(~known)])[bounds].astype(np.int32)
                found, codes, cuts = tree.parts(*with_ends(piece, part), rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(bounds).astype(np.int64)), pa.array(n_known), pa.array(sums), pa.array(found), pa.array(np.diff(part)),
                                                  pa.ListArray.from_arrays(ends, pa.array(rest)), pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(codes))], ["doc_id", "n_tokens", "n_known", "base", "score", "n_bytes", "rest", "codes"])

    own = d.mapInArrow(each, f"doc_id {kind}, n_tokens long, n_known long, base double, score double, n_bytes long, rest array<long>, codes array<long>")
    own = stored(own.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rest = own.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count("*").alias("tf"))
    counts = model.counts.filter("kind = 0").select("key", "n")
    added = F.col("tf") * F.log10((F.col("n") + 0.1) / F.lit(floor))
    found = rest.join(counts, "key").select("row", F.col("tf").alias("more"), added.alias("add"), F.lit(0.0).alias("p"))
    codes = own.select("row", F.explode("codes").alias("key"))
    chances = stored(_log_chances(codes.select("key").distinct(), model), "lm-rest")
    under = codes.join(small(chances, SENT), "key").select("row", F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("add"), "p")
    found = found.unionByName(under).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more", "add", "p")])
    out = own.drop("rest", "codes").join(found, "row", "left").withColumn("score", F.col("score") + F.coalesce("p", F.lit(0.0)))
    more, zero = F.coalesce("more", F.lit(0)), F.lit(float(np.log10(0.1 / floor)))
    known = F.col("n_known") + more
    return out.select("doc_id", "n_tokens", known.alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("add", F.lit(0.0)) + (F.col("n_tokens") - known) * zero).alias("base_score"), "score",
                      F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"))


def query(docs: DataFrame) -> DataFrame:
    model = fit(docs.filter(remainder(F.col("doc_id"), 10) != 0))
    return score(docs, model).withColumn("held_out", remainder(F.col("doc_id"), 10) == 0).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
