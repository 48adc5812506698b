"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

Tokens are runs of letters, digits and ``+/_.-``. A token is tagged secret begin,
inside or outside from its shape, the word before it and whether an assignment
sign stands between, the shape after it, and how often the whole text assigns.
The field is trained here: the pattern matches of a bounded, hash-drawn sample of
about ``SAMPLE`` documents are the labels, windows of ``WINDOW`` tokens around
them and around other tokens are the sequences. So that the field finds what the patterns
do not, windows with planted forms join them: made-up values behind a word that hints at
a secret are secrets whatever the word is; the same values elsewhere, and plain words
behind such a word, are not. Texts are decoded whole by
Viterbi; a token whose outside score wins whatever its neighbours are cuts the
chain, so only short stretches between such tokens need the recursion (the result
is the same).

Pattern matches always stay; a tagged run that overlaps none of them is added with
kind ``crf``. Offsets are code points, ends exclusive. Null and empty texts have
no spans. Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasemill.llm.common import FOLD, range_hashes, slices, text_bytes

# Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

SAMPLE, WINDOW, BUCKETS, STEPS, DECAY, PLANTED = 5000, 9, 512, 80, 0.1, 4000
TOKEN = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.-":
    TOKEN[_c] = True
TOKEN[128:] = True
_is = lambda lo, hi: (np.arange(256) >= lo) & (np.arange(256) <= hi)
DIGIT, UPPER, LOWER = _is(48, 57), _is(65, 90), _is(97, 122)
MARK, WIDE = TOKEN & ~DIGIT & ~UPPER & ~LOWER & ~_is(128, 255), _is(128, 255)
SETS = (ord("="), ord(":"))
N_SHAPES, N_NEXT, N_FILE = 5 * 3 * 3 * 2 * 2 * 2, 15, 3


def pattern_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself), in order."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def _find(data: bytes, word: bytes) -> list[int]:
    out, at = [], data.find(word)
    while at >= 0:
        out.append(at)
        at = data.find(word, at + 1)
    return out


# Fixed parts of words that name a secret.
HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"cred", b"bearer")
HEXDIGIT = DIGIT | _is(97, 102)


def _suspects(data: np.ndarray, offsets: np.ndarray) -> set[int]:
    """Documents that may have a pattern match."""
    raw, folded = data.tobytes(), FOLD[data].tobytes()
    at = [p for w in (b"passw", b"secret", b"token", b"apikey", b"api_key") for p in _find(folded, w)] + _find(raw, b"AKIA")
    run = HEXDIGIT[data]
    # The texts lie end to end: a run ends with its text.
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.concatenate([[False], run[:-1]]) & ~edge[:-1], np.concatenate([run[1:], [False]]) & ~edge[1:]
    start, end = np.flatnonzero(run & ~before), np.flatnonzero(run & ~after) + 1
    at += start[end - start >= 24].tolist()
    return set((np.searchsorted(offsets, at, "right") - 1).tolist()) if at else set()


def tokens(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Tokens of all documents with their features as small whole numbers."""
    inside = TOKEN[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.concatenate([[False], inside[:-1]]) & ~edge[:-1], np.concatenate([inside[1:], [False]]) & ~edge[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1

    def count(mask):
        run = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int32)])
        return run[end] - run[start], run

    n = end - start
    digits, uppers, lowers, marks = (count(m)[0] for m in (DIGIT, UPPER, LOWER, MARK))
    wide = count(WIDE)[0]
    length = np.digitize(n, [6, 12, 20, 32])
    many = np.where(digits == 0, 0, np.where(4 * digits < n, 1, 2))
    capital = np.where(uppers == 0, 0, np.where((uppers == 1) & UPPER[data[start]], 1, 2))
    shape = ((((length * 3 + many) * 3 + capital) * 2 + (lowers > 0)) * 2 + (marks > 0)) * 2 + (wide > 0)
    signs = np.concatenate([[0], np.cumsum((data == SETS[0]) | (data == SETS[1]), dtype=np.int32)])
    first = np.ones(len(start), bool)
    first[1:] = doc[1:] != doc[:-1]
    last_end = np.concatenate([[0], end[:-1]])
    assigned = np.where(first, 0, (signs[start] - signs[np.where(first, start, last_end)]) > 0).astype(np.int64)
    bucket = (range_hashes(FOLD[data], start, end) % np.uint64(BUCKETS)).astype(np.int64)
    plain = (digits == 0) & (marks == 0)
    prior = np.where(first, BUCKETS, np.concatenate([[0], np.where(plain, bucket, BUCKETS + 1)[:-1]]))
    named = np.zeros(len(start) + 1, np.int64)
    folded = FOLD[data].tobytes()
    named[np.searchsorted(start, [p for w in HINTS for p in _find(folded, w)], "right")] = 1
    hint = np.where(first, 0, named[:-1])  # of the token before
    following = np.concatenate([(length * 3 + many)[1:], [0]])
    following[np.concatenate([first[1:], [True]])] = 0
    per_doc = signs[offsets[1:]] - signs[offsets[:-1]]
    file = np.where(per_doc == 0, 0, np.where(100 * per_doc < np.diff(offsets), 1, 2))
    return {"start": start, "end": end, "doc": doc, "shape": shape, "prior": prior, "hint": 2 * assigned + hint, "next": following, "file": file[doc], "odd": digits > 0}


FEATURES = (("shape", N_SHAPES), ("prior", BUCKETS + 2), ("hint", 4), ("next", N_NEXT), ("file", N_FILE))


class Field:
    """Weights per feature value and tag (outside, begin, inside), and of tag pairs."""

    def __init__(self):
        self.weights = [np.zeros((n, 3)) for _, n in FEATURES]
        self.pairs = np.zeros((3, 3))

    def emissions(self, t: dict[str, np.ndarray]) -> np.ndarray:
        return sum(w[t[name]] for w, (name, _) in zip(self.weights, FEATURES))

    def train(self, x: np.ndarray, tags: np.ndarray, used: np.ndarray) -> Field:
        """x: windows x positions x features; tags likewise; ``used`` is false past a window's end. Ascends the likelihood."""
        params = [*self.weights, self.pairs]
        memory = [np.full_like(p, 1e-8) for p in params]
        s, n = tags.shape
        at = [x[:, :, k][used] for k in range(len(self.weights))]
        for _ in range(STEPS):
            e = sum(w[x[:, :, k]] for k, w in enumerate(self.weights))
            e[~used] = [0.0, -1e9, -1e9]
            forward, back = np.empty((s, n, 3)), np.zeros((s, n, 3))
            forward[:, 0] = e[:, 0] + self.pairs[0]
            for i in range(1, n):
                forward[:, i] = e[:, i] + np.logaddexp.reduce(forward[:, i - 1, :, None] + self.pairs, axis=1)
            back[:, n - 1] = self.pairs[:, 0]
            for i in range(n - 2, -1, -1):
                back[:, i] = np.logaddexp.reduce(self.pairs + (e[:, i + 1] + back[:, i + 1])[:, None, :], axis=2)
            norm = np.logaddexp.reduce(forward[:, n - 1] + self.pairs[:, 0], axis=1)
            single = np.exp(forward + back - norm[:, None, None])
            delta = (np.eye(3)[tags] - single) * used[:, :, None]
            grads = []
            for k, w in enumerate(self.weights):
                grads.append(np.column_stack([np.bincount(at[k], weights=delta[:, :, tag][used], minlength=len(w)) for tag in range(3)]))
            g = np.zeros((3, 3))
            for i in range(1, n):
                both = np.exp(forward[:, i - 1, :, None] + self.pairs + (e[:, i] + back[:, i])[:, None, :] - norm[:, None, None])
                live = used[:, i]
                g -= both[live].sum(0)
                np.add.at(g, (tags[live, i - 1], tags[live, i]), 1)
            grads.append(g)
            for p, m, d in zip(params, memory, grads):
                d = d - DECAY * p
                m += d * d
                p += 0.5 * d / np.sqrt(m)
        return self

    def decode(self, e: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Viterbi tags of all tokens; every text starts and ends outside."""
        tags = np.zeros(len(e), np.int8)
        spread = 2 * (self.pairs.max() - self.pairs.min())
        open_ = e[:, 0] - np.maximum(e[:, 1], e[:, 2]) <= spread
        if not open_.any():
            return tags
        new = open_.copy()
        new[1:] &= ~open_[:-1] | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        stop = open_.copy()
        stop[:-1] &= ~open_[1:] | (doc[1:] != doc[:-1])
        size = np.flatnonzero(stop) + 1 - at
        best = self.pairs[0] + e[at]
        trail: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(1, int(size.max())):
            live = np.flatnonzero(size > k)
            options = best[live][:, :, None] + self.pairs
            trail.append((live, options.argmax(1)))
            best[live] = options.max(1) + e[at[live] + k]
        tag = (best + self.pairs[:, 0]).argmax(1)
        tags[at + size - 1] = tag
        for k in range(len(trail), 0, -1):
            live, come = trail[k - 1]
            tag[live] = come[np.arange(len(live)), tag[live]]
            tags[at[live] + k - 1] = tag[live]
        return tags


def _code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte, and in all."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training windows of one slice: features, tags and which positions are used."""
    t = tokens(data, offsets)
    tags = np.zeros(len(t["start"]), np.int64)
    for k in _suspects(data, offsets):
        own = data[offsets[k]: offsets[k + 1]]
        byte_of = np.flatnonzero(np.append((own & 0xC0) != 0x80, True))
        for _, _, end, secret in pattern_spans(own.tobytes().decode()):
            a, b = byte_of[secret] + offsets[k], byte_of[end] + offsets[k]
            i, j = np.searchsorted(t["end"], a, "right"), np.searchsorted(t["start"], b, "left")
            tags[i:j] = 2
            tags[i: i + 1] = 1
    centres = np.flatnonzero((tags == 1) | t["odd"] | (range_hashes(data, t["start"], t["end"]) % np.uint64(197) == 0))
    at = centres[:, None] + np.arange(WINDOW) - WINDOW // 2
    used = (at >= 0) & (at < len(tags))
    at = np.clip(at, 0, max(0, len(tags) - 1))
    used &= t["doc"][at] == t["doc"][centres][:, None]
    x = np.stack([t[name][at] for name, _ in FEATURES], axis=2)
    marked = np.where(used, tags[at], 0)
    # Each window with a secret once more with the word before it unknown, so that other names work too.
    again = np.flatnonzero((marked == 1).any(1))
    unnamed = x[again]
    unnamed[marked[again] > 0, 1] = BUCKETS + 1
    x, marked, used = np.concatenate([x, unnamed]), np.concatenate([marked, marked[again]]), np.concatenate([used, used[again]])
    return x.astype(np.int32), marked.astype(np.int32), used


def _made_up(rng: np.random.Generator, n: int, long: bool) -> np.ndarray:
    """Shapes of ``n`` random values of 8 to 40 characters (``long``: 20 to 40 of both cases) with a digit at least."""
    letters, digits, marks = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_.-"
    values = []
    for size, style in zip(rng.integers(20 if long else 8, 41, n), rng.integers(0, 4, n)):
        pool = letters[:26] + digits if style == 0 and not long else letters + digits + (marks if style == 1 else "")
        made = [pool[k] for k in rng.integers(0, len(pool), size)]
        made[int(rng.integers(1, size - 1))] = digits[int(rng.integers(0, 10))]
        values.append("k" + "".join(made[1:-1]) + "Q" if style else "".join(made).strip(marks))
    return tokens(*text_bytes(pa.array(values)))["shape"]


def _planted(x: np.ndarray, tags: np.ndarray, used: np.ndarray, n: int = PLANTED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``n`` windows without a secret, drawn with a fixed seed, with a planted token in the middle.

    Three in five are secrets: any value assigned to a hinting word, or a long one that only follows
    one. The others are not: the window's own token behind a hinting word, and values without one,
    or short ones that only follow one. The word before is unknown in all of them.
    """
    rng, mid = np.random.default_rng(7), WINDOW // 2
    free = np.flatnonzero(~tags.any(1) & used[:, mid] & used[:, mid - 1])
    if not len(free):
        return x[:0], tags[:0], used[:0]
    pick, kind = rng.choice(free, n), np.arange(n) % 5
    x, tags, used = x[pick].copy(), tags[pick].copy(), used[pick]
    any_, long = _made_up(rng, n, False), _made_up(rng, n, True)
    length = any_ // (N_SHAPES // 5)
    shape = np.select([kind < 2, kind == 2, kind == 3], [any_, long, x[:, mid, 0]], any_)
    hint = np.select([kind < 2, kind == 2, kind == 3], [3, 1, rng.choice([3, 3, 1], n)], rng.choice([0, 2], n))
    hint[(kind == 4) & (length < 3) & (rng.random(n) < 0.5)] = 1
    x[:, mid, 0], x[:, mid, 1], x[:, mid, 2] = shape, BUCKETS + 1, hint
    x[:, mid - 1, 3] = shape // (N_SHAPES // 15)
    signs = np.where(hint >= 2, np.maximum(x[:, mid, 4], rng.integers(1, 3, n)), x[:, mid, 4])
    x[:, :, 4] = signs[:, None]
    tags[:, mid] = kind < 3
    return x, tags, used


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Field:
    """Train on the windows of a hash-drawn sample of documents."""
    total = max(1, docs.count())
    draw = F.pmod(F.xxhash64(doc_id, F.lit("secrets")), F.lit(1 << 30))
    d = docs.filter(draw < F.lit(int(min(1.0, sample / total) * (1 << 30)))).select(F.col(text).cast("string").alias("text"))

    def each(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in slices(offsets):
                part = offsets[i: j + 1]
                x, tags, used = _windows(data[part[0]: part[-1]], part - part[0])
                # Equal windows count once, so what a corpus repeats doesn't outweigh the rest.
                rows = np.unique(np.column_stack([x.reshape(len(x), -1), tags, used.astype(np.int32)]), axis=0) if len(x) else np.zeros((0, 1), np.int32)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], ["window"])

    rows = sorted({bytes(r["window"]) for r in d.mapInArrow(each, "window binary").distinct().collect()})
    field = Field()
    if not rows:
        return field
    flat = np.frombuffer(b"".join(rows), np.int32).reshape(len(rows), -1)
    k = len(FEATURES) * WINDOW
    own = flat[:, :k].reshape(-1, WINDOW, len(FEATURES)), flat[:, k: k + WINDOW], flat[:, k + WINDOW:].astype(bool)
    return field.train(*(np.concatenate(both) for both in zip(own, _planted(*own))))


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def spans_of(data: np.ndarray, offsets: np.ndarray, field: Field) -> list[list[tuple[str, int, int]]]:
    """All spans of each document, by start and kind."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    if not len(data):
        return [[] for _ in found]
    for k in _suspects(data, offsets):
        found[k] = [(s, kind, e) for s, kind, e, _ in pattern_spans(data[offsets[k]: offsets[k + 1]].tobytes().decode())]
    t = tokens(data, offsets)
    tagged = field.decode(field.emissions(t), t["doc"])
    hit = np.flatnonzero(tagged)
    i = 0
    while i < len(hit):
        j = i + 1
        while j < len(hit) and hit[j] == hit[j - 1] + 1 and tagged[hit[j]] == 2 and t["doc"][hit[j]] == t["doc"][hit[i]]:
            j += 1
        k = int(t["doc"][hit[i]])
        points = _code_points(data[offsets[k]: offsets[k + 1]])
        a, b = int(points[t["start"][hit[i]] - offsets[k]]), int(points[t["end"][hit[j - 1]] - offsets[k]])
        if all(b <= s or a >= e for s, kind, e in found[k] if kind < 3):
            found[k].append((a, 3, b))
        i = j
    return [[(KINDS[kind], s, e) for s, kind, e in sorted(f)] for f in found]


def scan(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) of every whole text."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                part = offsets[i: j + 1]
                spans = [[dict(zip(("kind", "start", "end"), s)) for s in x] for x in spans_of(data[part[0]: part[-1]], part - part[0], sent.value)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(spans, kind)], ["doc_id", "spans"])

    return d.mapInArrow(each, T.StructType([T.StructField("doc_id", d.schema["doc_id"].dataType), T.StructField("spans", SPAN)]))


def redact(docs: DataFrame, field: Field, text: str = "text", mark: str = "<secret>", length: str | None = None) -> DataFrame:
    """The documents with every span replaced by ``mark``; ``length`` names a column of code points to renew."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index(text)

    def each(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(at).cast(pa.string()))
            out: list[str | None] = batch.column(at).to_pylist()
            for i, j in slices(offsets):
                part = offsets[i: j + 1]
                for k, spans in enumerate(spans_of(data[part[0]: part[-1]], part - part[0], sent.value)):
                    if spans:
                        t, pieces, upto = out[i + k], [], 0
                        for _, a, b in spans:
                            if a >= upto:
                                pieces += [t[upto:a], mark]
                            upto = max(upto, b)
                        out[i + k] = "".join([*pieces, t[upto:]])
            columns = [pa.array(out, batch.column(n).type) if n == at else batch.column(n) for n in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(each, docs.schema)
    return out.withColumn(length, F.when(F.col(text).isNotNull(), F.length(text)).cast(docs.schema[length].dataType)) if length in docs.columns else out


def query(docs: DataFrame) -> DataFrame:
    s = scan(docs, fit(docs))
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return s.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(line(F.filter("spans", lambda x: x["kind"] != "crf")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
