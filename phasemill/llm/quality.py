"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Each whole text becomes a fixed row of statistics, written once. Random Fourier
features of the standardised statistics approximate a Gaussian kernel; every
task sums its part of the normal equations over all labelled training rows, the
parts are added up, and the ridge weights solve the sum. Raw scores of the
training rows, counted per fixed score bin, give a monotone calibration by
pooling adjacent violators.

Null and empty texts have all statistics zero and are scored like any text.
Rows of labels without a quality are ignored; several labels of one document
count as their mean, rounded up. Without any label the score is 0.5. Repeated
documents give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.llm.common import FOLD, GAP, hashed_words, remainder, slices, stored, text_bytes

#: Random features, ridge penalty, kernel width in standard deviations, score bins, tasks that add up parts.
FEATURES, PENALTY, WIDTH, BINS, ADDERS = 192, 1.0, 3.0, 2048, 16


def _class(members: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in members]] = True
    return out


def _classes() -> list[np.ndarray]:
    upper, digit = np.zeros(256, bool), np.zeros(256, bool)
    upper[65:91], digit[48:58] = True, True
    tail = np.zeros(256, bool)
    tail[192:256] = True
    return [upper, digit, _class(".,;:?"), _class("!"), _class("#*$%&<>"), _class("|"), _class("\n"), _class("()[]{}\"'-_/\\=+@~^`"), tail, GAP]


CLASSES = _classes()
NAMES = ["log_words", "word_bytes", *[f"class_{i}" for i in range(len(CLASSES))], "distinct", "repeated_next", "repeated_lines", "line_words", "no_letter", "top_word"]
LETTER = np.zeros(256, bool)
LETTER[65:91], LETTER[97:123], LETTER[128:] = True, True, True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return run[offsets[1:]] - run[offsets[:-1]]


def _distinct(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the count of the most frequent key, by document."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(first)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[at], np.diff(np.append(at, len(k))))
    return np.bincount(d[at], minlength=n), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics per document."""
    n_bytes = np.diff(offsets).astype(float)
    some = np.maximum(n_bytes, 1)
    words, bounds = hashed_words(FOLD[data], offsets)
    n_words = np.diff(bounds).astype(float)
    w = np.maximum(n_words, 1)
    shares = [_per_doc(c[data], offsets) / some for c in CLASSES]
    lines, line_bounds = hashed_words(data, offsets, NEWLINE)
    n_lines = np.maximum(np.diff(line_bounds), 1)
    distinct, most = _distinct(words, bounds)
    distinct_lines, _ = _distinct(lines, line_bounds)
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    starts = bounds[:-1][np.diff(bounds) > 0]
    same[starts] = False
    letters = _per_doc(LETTER[data], offsets)
    non_gap = n_bytes - _per_doc(GAP[data], offsets)
    return np.column_stack([np.log1p(n_words), np.minimum(non_gap / w, 40), *shares, distinct / w / np.maximum(1, np.log1p(w)) * 5, _per_doc(same, bounds) / w,
                            (np.diff(line_bounds) - distinct_lines) / n_lines, np.log1p(w / n_lines), 1 - letters / np.maximum(non_gap, 1), most / w]).astype(np.float64)


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stats array<double>) of every document."""

    def each(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets):
                part = offsets[i: j + 1]
                stats = statistics(data[part[0]: part[-1]], part - part[0])
                flat = pa.array(stats.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(np.arange(j - i + 1, dtype=np.int32) * stats.shape[1], flat)], ["doc_id", "stats"])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(each, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, stats array<double>")


def _matrix(batch: pa.RecordBatch, column: str = "stats") -> np.ndarray:
    values = batch.column(column)
    return np.asarray(values.flatten()).reshape(len(values), -1)


def _summed(df: DataFrame, part) -> np.ndarray | None:
    """Sum over all rows of ``part(batch) -> array``: each task adds up its own, a few tasks add those up."""

    def own(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = part(batch)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([str(total.shape)])], ["sum", "shape"])

    def added(batches):
        total, shape = None, None
        for batch in batches:
            for b, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(b)
                total, shape = (x if total is None else total + x), s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([shape])], ["sum", "shape"])

    kind = "sum binary, shape string"
    rows = df.mapInArrow(own, kind).repartition(ADDERS).mapInArrow(added, kind).collect()
    if not rows:
        return None
    shape = tuple(int(x) for x in rows[0]["shape"].strip("()").split(",") if x.strip())
    return sum(np.frombuffer(r["sum"]) for r in rows).reshape(shape)


class Model:
    """Standardisation, random features, ridge weights and the calibration curve."""

    def __init__(self, mean, scale, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.omega = rng.normal(size=(len(mean), FEATURES)) / WIDTH
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights, self.curve = None, None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(z @ self.omega + self.phase) * np.sqrt(2 / FEATURES), z * 0.1, np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), *self.curve)


def isotonic(centres: np.ndarray, counts: np.ndarray, positives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the knots of a rising curve of shares in [0, 1]."""
    blocks: list[list[float]] = []  # weight, positives, first centre, last centre
    for c, n, p in zip(centres, counts, positives):
        if n:
            blocks.append([n, p, c, c])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                n2, p2, _, last = blocks.pop()
                blocks[-1][0] += n2
                blocks[-1][1] += p2
                blocks[-1][3] = last
    x, y = [], []
    for n, p, first, last in blocks:
        share = (p + 0.5) / (n + 1)
        for at in ([first, last] if last > first else [first]):
            x.append(at)
            y.append(share)
    return np.array(x), np.maximum.accumulate(np.array(y))


def fit(stats: DataFrame, labels: DataFrame, target: str = "quality", doc_id: str = "doc_id") -> Model | None:
    """Fit on all rows of ``stats`` that ``labels`` marks (labels must hold training rows only)."""
    marks = labels.select(F.col(doc_id).alias("l_id"), F.col(target).cast("double").alias("y")).dropna().groupBy("l_id").agg(F.ceil(F.avg("y")).cast("double").alias("y"))
    train = stored(stats.join(marks, F.col("doc_id") == F.col("l_id")).select("stats", "y"), "quality-train")
    moments = _summed(train, lambda b: (lambda x: np.stack([np.full(x.shape[1], float(len(x))), x.sum(0), (x * x).sum(0)]))(_matrix(b)))
    if moments is None:
        return None
    n, mean = moments[0], moments[1] / moments[0]
    model = Model(mean, np.sqrt(np.maximum(moments[2] / n - mean**2, 1e-8)))

    def normal(b):
        x = model.features(_matrix(b))
        xy = np.column_stack([x, 2 * np.asarray(b.column("y")) - 1])
        return xy.T @ xy

    total = _summed(train, normal)
    gram, right = total[:-1, :-1], total[:-1, -1]
    model.weights = np.linalg.solve(gram + PENALTY * np.eye(len(gram)), right)
    edges = np.linspace(-2, 2, BINS + 1)

    def binned(b):
        at = np.clip(np.digitize(model.raw(_matrix(b)), edges) - 1, 0, BINS - 1)
        return np.stack([np.bincount(at, minlength=BINS).astype(float), np.bincount(at, weights=np.asarray(b.column("y")), minlength=BINS)])

    counts, positives = _summed(train, binned)
    model.curve = isotonic((edges[:-1] + edges[1:]) / 2, counts, positives)
    return model


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every row of statistics."""

    def each(batches):
        for batch in batches:
            s = np.full(batch.num_rows, 0.5) if model is None or not batch.num_rows else model.score(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return stats.mapInArrow(each, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = stored(document_statistics(docs), "quality-stats")
    model = fit(stats, labels.filter(remainder(F.col("doc_id"), 3) != 1))
    return score(stats, model).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
