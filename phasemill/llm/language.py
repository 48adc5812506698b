"""Language identification by string kernels.

A text is the set of its byte n-grams of lengths 1 to 3 (blended spectrum, with
A-Z folded and every byte that is no letter read as a space); the kernel of two
texts is the cosine of these presence sets. Landmark texts give a Nyström
approximation; one-versus-rest kernel ridge regression on it gives one score per
language. Texts are scored whole, in batches: one matrix product of presence
rows with the landmarks' presence rows, one with the weights.

Training rows are a bounded sample: about ``PER_LANGUAGE`` documents of each
language, drawn by a hash of their id, ``TOTAL`` documents at most in expectation.
Their n-gram sets go to the driver, never their texts.

A null text, or one without any letter, is ``und`` with score 0; so is every text
if nothing could be learned. Null languages are never learned. Repeated rows give
repeated rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasemill.llm.common import FOLD, remainder, slices, text_bytes

PER_LANGUAGE, TOTAL, LANDMARKS, PENALTY, SHARPNESS = 300, 2000, 32, 0.05, 4.0
READ = np.full(256, 32, np.uint8)
READ[65:91] = FOLD[65:91]
READ[97:123] = np.arange(97, 123)
READ[128:] = np.arange(128, 256)


def _grams(b: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, documents) of the 1-, 2- and 3-grams; none crosses a document's end."""
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    c = b.astype(np.int32)
    out = [(c, doc)]
    for n in (2, 3):
        c = (c[:-1] << 8) | b[n - 1:]
        inside = doc[: len(c)] == doc[n - 1:]
        out.append((c[inside] | (n << 24), doc[: len(c)][inside]))
    return out


def gram_set(data: np.ndarray) -> np.ndarray:
    """Distinct n-gram codes of one text; the code's top byte is the length (0 for 1)."""
    b = READ[data]
    return np.unique(np.concatenate([c for c, _ in _grams(b, np.array([0, len(b)]))])) if len(b) else np.zeros(0, np.int32)


class Model:
    """Landmark presence rows over their own n-grams, and one weight column per language."""

    def __init__(self, sets: list[np.ndarray], languages: list[str]):
        self.languages = sorted(set(languages))
        seen = {x: 0 for x in self.languages}
        marks = []
        for i, lang in enumerate(languages):
            if seen[lang] < LANDMARKS:
                seen[lang] += 1
                marks.append(i)
        grams, counts = np.unique(np.concatenate([sets[i] for i in marks]), return_counts=True)
        self.grams = grams[counts >= min(2, len(marks))]
        rows = self._rows(sets)
        self.landmarks = self._unit(rows[marks]).T.copy()
        k = self._unit(rows) @ self.landmarks
        values, vectors = np.linalg.eigh(k[marks].astype(float))
        use = values > 1e-6 * values[-1]
        root = vectors[:, use] / np.sqrt(values[use])
        phi = np.column_stack([k @ root, np.ones(len(k))])
        y = np.where(np.array(languages)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        w = np.linalg.solve(phi.T @ phi + PENALTY * np.eye(phi.shape[1]), phi.T @ y)
        self.weights, self.bias = (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def _rows(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(self.grams)), np.float32)
        for i, s in enumerate(sets):
            out[i, np.searchsorted(self.grams, np.intersect1d(s, self.grams))] = 1
        return out

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))

    def tables(self) -> list[np.ndarray]:
        """Per n-gram length: code -> column, -1 where no landmark has it."""
        out = []
        for n, size in ((0, 1 << 8), (2, 1 << 16), (3, 1 << 24)):
            table = np.full(size, -1, np.int32)
            own = np.flatnonzero(self.grams >> 24 == n)
            table[self.grams[own] & 0xFFFFFF] = own
            out.append(table)
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of each text."""
        n, d = len(offsets) - 1, len(self.grams)
        rows = np.zeros(n * d, np.float32)
        b = READ[data]
        for i in range(0, n, 64):  # presence is set for 64 texts at a time
            part = offsets[i: min(n, i + 64) + 1]
            for (codes, doc), table in zip(_grams(b[part[0]: part[-1]], part - part[0]), tables):
                at = table[codes & 0xFFFFFF]
                known = at >= 0
                rows[(doc[known].astype(np.int64) + i) * d + at[known]] = 1
        f = self._unit(rows.reshape(n, d)) @ self.landmarks @ self.weights + self.bias
        e = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
        best = f.argmax(1)
        return best, (e[np.arange(n), best] / e.sum(1)).astype(float)


def fit(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Learn from rows where ``train`` holds and text and language are not null."""
    rows = docs.filter(train & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    quota = max(2, min(PER_LANGUAGE, TOTAL // len(counts)))
    share = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(min(1.0, quota / v)))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("landmark")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.withColumn("draw", draw).filter(F.col("draw") < F.element_at(share, F.col("lang")))

    def each(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            sets = [gram_set(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("lang"), pa.array([s.tobytes() for s in sets], pa.binary())], ["draw", "lang", "grams"])

    got = sorted(sample.mapInArrow(each, "draw double, lang string, grams binary").collect(), key=lambda r: (r["draw"], r["lang"], r["grams"]))
    got = [r for r in got if len(r["grams"])]
    return Model([np.frombuffer(r["grams"], np.int32) for r in got], [r["lang"] for r in got]) if got else None


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        model = sent.value
        tables = model.tables() if model else None
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).cast(pa.uint8())).astype(bool)
            for i, j in slices(offsets):
                part, ok = offsets[i: j + 1], letters[i:j]
                if model:
                    best, score = model.predict(data[part[0]: part[-1]], part - part[0], tables)
                    names, score = np.where(ok, np.array(model.languages, object)[best], "und"), np.where(ok, score, 0.0)
                else:
                    names, score = np.full(j - i, "und", object), np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return d.mapInArrow(each, f"doc_id {kind}, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    model = fit(docs, remainder(F.col("doc_id"), 4) != 2)
    return predict(docs, model).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
