"""Phrase collocations mined by Rabin-Karp fingerprints.

Texts are folded (A-Z), split at . , ; : ! ? and line ends into pieces and those at
spaces and tabs into words. Each word is hashed; prefix polynomials of the word
hashes then give the fingerprint of every n-gram in a text as one difference and one
product, n-grams across pieces left out. A fingerprint covers the language, so
counts are per language (null: 'und').

The shuffle aggregates fingerprints with pointers: a task adds up its own n-grams and
sends, for each range of the fingerprints, the sorted fingerprints, their counts and
one row in which each occurs, as compressed byte planes; a range is merged at once,
and what reaches ``least`` stays, with the first and the last row named. Phrases are
then read from both rows, where every occurrence of a wanted fingerprint is spelt out
and compared: one fingerprint with two spellings is a collision, and the work is done
again with other polynomials. So only frequent phrases are ever materialised. (62 bits
tell n-grams apart: a count could be touched by an n-gram of equal fingerprint that
occurs in neither row with a chance of distinct n-grams / 2^62.)

Tasks add up counts before the shuffle, so a word that is everywhere is one row per
task. Products of counts are decimals of 38 digits. Words without limit of length,
empty and null texts (no words), repeated rows (counted each) and null or repeated
ids (not read) are all right; a table without words gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasemill.llm.common import FOLD, STEP, mix, slices, stored, text_bytes, word_spans

LEAST, LONGEST, TOP, SHARE = 10, 3, 2000, 50
#: Keys that a task holds before it passes their counts on, and bytes of text for each range of the fingerprints.
HELD, RANGE = 1 << 21, 1 << 22
#: Top bits of the keys that name the bucket in which a task holds them.
BUCKET_BITS = 4
BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_GAP[list(BREAKS + SPACES)] = True


class Polynomials:
    """Byte codes and an odd base modulo 2^64 for one attempt; ``bits`` of a fingerprint are used."""

    def __init__(self, attempt: int = 0, bits: int = 64):
        rng = np.random.default_rng(1300 + attempt)
        self.codes = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = int(rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1
        self.mask = np.uint64((1 << bits) - 1)
        self._tables: list[np.ndarray] = []

    def powers(self, n: int) -> list[np.ndarray]:
        """Powers of the base and of its inverse."""
        if not self._tables or len(self._tables[0]) < n:
            with np.errstate(over="ignore"):
                self._tables = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, STEP + 4096), b, np.uint64)])) for b in (self.base, pow(self.base, -1, 1 << 64))]
        return self._tables

    def ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ranges of ``values``, from prefix polynomials."""
        power, inverse = self.powers(len(values))
        with np.errstate(over="ignore"):
            run = np.concatenate([[np.uint64(0)], np.cumsum(values * power[: len(values)], dtype=np.uint64)])
            return mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP, "right")))
            at = starts[i]
            out[i:j] = self.ranges(self.codes[data[at: ends[j - 1]]], starts[i:j] - at, ends[i:j] - at)
            i = j
        return out


class Grams:
    """The words of some texts laid end to end, and the fingerprints of their n-grams."""

    def __init__(self, poly: Polynomials, data: np.ndarray, offsets: np.ndarray, langs: list[str]):
        self.data, self.poly = FOLD[data], poly
        self.starts, self.ends = word_spans(self.data, offsets, _GAP)
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        breaks = np.concatenate([[0], np.cumsum(_BREAK[self.data])])[self.starts] if len(self.starts) else self.starts
        new = np.ones(len(self.starts), bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.piece = np.cumsum(new)
        tongues = sorted(set(langs))
        which = np.array([tongues.index(x) for x in langs], np.int64)
        raw = [np.array(list(x.encode()), np.uint8) for x in tongues]
        code = np.array([poly.ranges(poly.codes[b], np.array([0]), np.array([len(b)]))[0] for b in raw], np.uint64)
        self.salt = code[which][self.doc] if len(self.doc) else np.zeros(0, np.uint64)
        self.hashes = poly.words(self.data, self.starts, self.ends)

    def first_words(self, n: int) -> np.ndarray:
        """The first word of every n-gram that lies in one piece."""
        if len(self.piece) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[: len(self.piece) - n + 1] == self.piece[n - 1:])

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the n-grams that start there; the two low bits are n, with 0 for the language itself."""
        h = self.poly.ranges(self.hashes, at, at + n) if n else np.zeros(len(at), np.uint64)
        return (mix(h ^ self.salt[at]) & self.poly.mask & np.uint64(2**64 - 4)) | np.uint64(n)

    def spelt(self, at: int, n: int) -> str:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[at: at + n].tolist(), self.ends[at: at + n].tolist())).decode()


def _grams(batch: pa.RecordBatch, poly: Polynomials):
    """Bounded parts of a batch: first row, last row and n-grams."""
    data, offsets = text_bytes(batch.column("text"))
    for i, j in slices(offsets):
        yield i, j, Grams(poly, data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], batch.column("lang").slice(i, j - i).to_pylist())


def _summed(keys: np.ndarray, counts: np.ndarray, first: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Rows of equal keys as one, by rising key: counts added, least ``first``, greatest ``last``."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
    if not len(at):
        return keys, counts, first, first
    high = np.maximum.reduceat((first if last is None else last)[order], at)
    return keys[at], np.add.reduceat(counts[order], at), np.minimum.reduceat(first[order], at), high


class _Held:
    """The keys, counts and rows that a task holds, in buckets by the top bits of the keys.

    Buckets are merged one by one, so that merging takes a small part of what is
    held; they own their arrays, so that a merged one is let go at once.
    """

    def __init__(self):
        self.buckets: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(1 << BUCKET_BITS)]
        self.size = 0

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        kept = _summed(keys, np.ones(len(keys), np.uint32), rows)[:3]
        cuts = np.arange(len(self.buckets) + 1).astype(np.uint64)
        at = [0, *np.searchsorted(kept[0], cuts[1:-1] << np.uint64(64 - BUCKET_BITS)).tolist(), len(kept[0])]
        for bucket, lo, hi in zip(self.buckets, at, at[1:]):
            if hi > lo:
                bucket.append(tuple(x[lo:hi].copy() for x in kept))
        self.size += len(kept[0])

    def merge(self) -> None:
        for bucket in self.buckets:
            if len(bucket) > 1:
                bucket[:] = [_summed(*[np.concatenate([h[k] for h in bucket]) for k in range(3)])[:3]]
        self.size = sum(len(h[0]) for bucket in self.buckets for h in bucket)

    def take(self):
        """The merged buckets by rising keys; nothing is held then."""
        self.merge()
        for bucket in self.buckets:
            if bucket:
                yield bucket.pop()
        self.size = 0


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _packed(keys: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> bytes:
    """Rising keys, their counts and rows, as compressed byte planes of the keys' steps and the others' values."""
    return pa.compress(_planes(np.diff(keys, prepend=np.uint64(0))) + _planes(counts.astype(np.uint32)) + _planes(rows), codec="zstd", asbytes=True)


def _unpacked(n: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=20 * n, codec="zstd", asbytes=True), np.uint8).reshape(20, n)
    column = lambda a, b, kind: np.ascontiguousarray(planes[a:b].T).view(kind).ravel()
    return np.cumsum(column(0, 8, np.uint64), dtype=np.uint64), column(8, 12, np.uint32).astype(np.int64), column(12, 20, np.int64)


def _counted(texts: DataFrame, poly: Polynomials, least: int, longest: int) -> DataFrame:
    """(size, h, a, first, last): n-grams that reach ``least``, with counts and rows; size 0 counts a language's words.

    The fingerprints are cut into ranges by the bytes of all texts, so that a range
    holds about a million at any size of the input: they are hashes, and a task adds
    up its own before, so that a frequent n-gram is one entry of each task.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, min(size // RANGE, 1 << 30))

    def each(batches):
        held = _Held()

        def passed(keys, counts, rows):
            bounds = np.append(np.searchsorted(keys, least_keys), len(keys))
            own = np.flatnonzero(np.diff(bounds))
            blobs = [_packed(*[x[bounds[r]: bounds[r + 1]] for x in (keys, counts, rows)]) for r in own.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.diff(bounds)[own].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "n", "blob"])

        # The least key of range r has the high half ceil(r * 2^32 / ranges).
        least_keys = ((np.arange(ranges, dtype=np.uint64) << np.uint64(32)) + np.uint64(ranges - 1)) // np.uint64(ranges) << np.uint64(32)
        seen = 0
        for batch in batches:
            numbers = batch.column("row").to_numpy()
            for i, _, grams in _grams(batch, poly):
                row = numbers[i + grams.doc]
                places = [np.arange(len(row)), *[grams.first_words(n) for n in range(1, longest + 1)]]
                held.add(np.concatenate([grams.fingerprints(at, n) for n, at in enumerate(places)]), np.concatenate([row[at] for at in places]))
                seen += sum(map(len, places))
                full = seen >= 1 << 31  # counts have 32 bits
                if held.size >= HELD:
                    held.merge()
                    full |= held.size >= HELD // 2
                if full:
                    yield from (passed(*x) for x in held.take())
                    seen = 0
        yield from (passed(*x) for x in held.take())

    def joined(table: pa.Table) -> pa.Table:
        pieces = [_unpacked(n, blob.as_py()) for n, blob in zip(table.column("n").to_pylist(), table.column("blob"))]
        keys, counts, first, last = _summed(*[np.concatenate([p[k] for p in pieces]) for k in range(3)])
        sizes = (keys & np.uint64(3)).astype(np.int8)
        good = (counts >= least) | (sizes == 0)
        return pa.table({"size": sizes[good], "h": keys[good].view(np.int64), "a": counts[good], "first": first[good], "last": last[good]})

    found = texts.mapInArrow(each, "part int, n int, blob binary")
    return found.groupBy("part").applyInArrow(joined, "size tinyint, h long, a long, first long, last long")


def _spelt(texts: DataFrame, wanted: DataFrame, poly: Polynomials) -> DataFrame:
    """(size, h, lang, phrase, parts): each distinct spelling of the wanted fingerprints in the rows that they name.

    ``parts`` are the fingerprints of the first k words and of the rest, for every cut k.
    """
    by_row = wanted.select("size", "h", F.explode(F.array_distinct(F.array("first", "last"))).alias("w_row"))
    # A row's list holds no more than twice its own n-grams.
    by_row = by_row.groupBy("w_row").agg(F.collect_list(F.struct("size", "h")).alias("wanted"))

    def each(batches):
        for batch in batches:
            lists = batch.column("wanted")
            ends, items = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            sizes, hs = (items.field(k).to_numpy() for k in range(2))
            for i, j, grams in _grams(batch, poly):
                out: list[tuple] = []
                for n in range(2, LONGEST + 1):
                    mine = np.flatnonzero(sizes[ends[i]: ends[j]] == n) + ends[i]
                    at = grams.first_words(n)
                    if not len(mine) or not len(at):
                        continue
                    h = grams.fingerprints(at, n)
                    # Every word pair, say, of a row whose fingerprint the row's list asks for.
                    owner = np.searchsorted(ends, mine, "right") - 1 - i
                    name = lambda doc, h: mix(h.view(np.uint64) ^ mix(doc.astype(np.uint64)))
                    at = at[np.isin(name(grams.doc[at], h), name(owner, hs[mine]))]
                    spellings: dict[tuple[int, str], int] = {}
                    for k in at.tolist():
                        spellings.setdefault((int(grams.doc[k]), grams.spelt(k, n)), k)
                    at = np.array(list(spellings.values()), np.int64)
                    parts = np.stack([grams.fingerprints(at + s, m).view(np.int64) for k in range(1, n) for s, m in ((0, k), (k, n - k))], axis=1).tolist()
                    h = grams.fingerprints(at, n).view(np.int64).tolist()
                    out += [(n, h[x], batch.column("lang")[i + doc].as_py(), phrase, parts[x]) for x, (doc, phrase) in enumerate(spellings)]
                if out:
                    kinds = [pa.int8(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["size", "h", "lang", "phrase", "parts"])

    rows = texts.join(by_row.hint("merge"), F.col("row") == F.col("w_row")).select("lang", "text", "wanted")
    return rows.mapInArrow(each, "size tinyint, h long, lang string, phrase string, parts array<long>")


class Collision(RuntimeError):
    """One fingerprint with two spellings."""


def _mined(texts: DataFrame, poly: Polynomials, least: int, longest: int, share: int) -> DataFrame:
    counts = stored(_counted(texts, poly, least, longest), "phrase-counts")
    spelt = _spelt(texts, counts.filter("size > 1"), poly).groupBy("size", "h")
    spelt = stored(spelt.agg(F.min(F.struct("lang", "phrase")).alias("low"), F.max(F.struct("lang", "phrase")).alias("high"), F.first("parts").alias("parts")), "phrase-texts")
    # The words of a language are counted under its own fingerprint.
    totals = counts.filter("size = 0").select("h", F.col("a").alias("n"), F.explode(F.array_distinct(F.array("first", "last"))).alias("row"))
    totals = stored(totals.join(texts.select("row", "lang"), "row").groupBy("h", "n").agg(F.min("lang").alias("lang"), F.max("lang").alias("other")), "phrase-totals")
    if spelt.filter("low <> high").limit(1).count() or totals.filter("lang <> other").limit(1).count():
        raise Collision(f"two spellings of one fingerprint under the mask {poly.mask:x}")
    named = counts.filter("size > 1").join(spelt.drop("size", "high"), "h").select("size", "h", "a", "low.*", "parts")
    cut = named.select("size", "h", "a", F.posexplode(F.sequence(F.lit(1), F.col("size").cast("int") - 1)).alias("pos", "k"), "parts")
    cut = cut.select("h", "a", "k", F.get("parts", 2 * F.col("pos")).alias("left"), F.get("parts", 2 * F.col("pos") + 1).alias("right"))
    # A fingerprint holds its size, so it alone is the key.
    cut = cut.join(counts.select(F.col("h").alias("left"), F.col("a").alias("l")), "left").join(counts.select(F.col("h").alias("right"), F.col("a").alias("r")), "right")
    big = lambda c: f"cast({c} as decimal(19,0))"
    cut = cut.withColumn("score", F.expr(f"cast({big('a')} * {big('a')} * 1000000 as decimal(38,0)) div ({big('l')} * {big('r')})"))
    best = cut.groupBy("h").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # The two pairs within three words: the right part of the first cut and the left part of the second.
    holds = named.filter("size = 3").select("a", F.explode(F.array(F.get("parts", F.lit(1)), F.get("parts", F.lit(2)))).alias("h"))
    holds = holds.groupBy("h").agg(F.max("a").alias("held"))
    out = named.join(best, "h").join(holds, "h", "left").filter(F.col("held").isNull() | (100 * F.col("held") < share * F.col("a")))
    return out.join(totals.drop("h", "other"), "lang").select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, share: int = SHARE, bits: tuple[int, ...] = (64, 64, 64, 64)) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of 2 to ``longest`` (at most 3) words that occur ``least`` times
    and do not lie in a longer such phrase with ``share`` percent of their count. ``bits`` are those of each attempt's fingerprints."""
    if not 2 <= longest <= LONGEST:
        raise ValueError("phrases have two or three words")
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    texts = stored(texts.filter("text <> ''").withColumn("row", F.monotonically_increasing_id()), "phrase-rows")
    for attempt, width in enumerate(bits):
        try:
            return _mined(texts, Polynomials(attempt, width), least, longest, share)
        except Collision:
            if attempt == len(bits) - 1:
                raise
    raise ValueError("no attempt was asked for")


def best_of(found: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` phrases of each language, ranked; first within 64 parts of a language, so no task ranks more than 64 limits."""
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    some = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= limit)
    return some.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= limit)


def query(docs: DataFrame) -> DataFrame:
    return best_of(collocations(docs), TOP).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, len, unnest(list_transform(range(1, len(w) - len + 2), lambda i: array_to_string(w[i:i+len-1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) z(len) WHERE len(w) >= len),
f AS MATERIALIZED (SELECT lang, len, phrase, count(*) AS a, string_split(phrase, ' ') AS p FROM g GROUP BY lang, len, phrase HAVING count(*) >= 10),
cuts AS (SELECT lang, len, phrase, a, k, array_to_string(p[1:k], ' ') AS lp, array_to_string(p[k+1:len], ' ') AS rp, p FROM f, (VALUES (1), (2)) z(k) WHERE len > k),
s AS (SELECT c.lang, c.len, c.phrase, c.a, c.k, l.a AS l, r.a AS r, (c.a::HUGEINT * c.a * 1000000) // (l.a::HUGEINT * r.a) AS score FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.len = c.k AND l.phrase = c.lp JOIN f r ON r.lang = c.lang AND r.len = c.len - c.k AND r.phrase = c.rp),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, len, phrase ORDER BY score, k) AS o FROM s),
h AS (SELECT lang, inner_phrase, max(a) AS held FROM (SELECT lang, a, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS inner_phrase FROM f WHERE len = 3) GROUP BY ALL),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score
  FROM b JOIN n ON n.lang = b.lang LEFT JOIN h ON b.len = 2 AND h.lang = b.lang AND h.inner_phrase = b.phrase WHERE b.o = 1 AND (h.held IS NULL OR 100 * h.held < 50 * b.a))
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000"""
