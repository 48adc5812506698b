"""Benchmark decontamination (native: DataFrame functions only).

Words are runs of ASCII letters, digits and characters above U+007F, with A-Z
lower-cased. A window is 13 consecutive words of an item; a shorter item is one
window. The hashes of the windows are broadcast (behind a check of their number;
a larger benchmark is joined by shuffle), a document's own windows are looked up
by hash, and a hit counts after its words have been compared.

Null texts have no words. Items without words have no windows; items that share
an id count once; a null item id marks words as hit but is in no list. Documents
that repeat (same id, same text) give a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasemill.llm.common import ascii_lower

WINDOW = 13
#: A broadcast of windows has at most so many rows.
BROADCAST_WINDOWS = 100_000
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), GAPS), lambda w: w != "")


def _window_hash(hashes: str, n: int):
    """The hash of the n words from position i on; words past the end change nothing."""
    return lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)])


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: words, length, hash and the sorted ids of their items."""
    b = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.lit(window), F.size("w"))
    b = b.select("item", n.alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("gram"))
    return b.groupBy("gram", "len").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("wh", F.transform("gram", lambda x: F.xxhash64(x))).withColumn("h", _window_hash("wh", window)(F.lit(0))).drop("wh")


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, tag, starts, items) of documents with a hit; ``tag`` hashes the text; starts are (word position, length)."""
    win = windows(benchmark, window=window)
    shape = win.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("len")).alias("lens")).first()
    small = shape.n <= BROADCAST_WINDOWS
    lens = shape.lens or [window]
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tag"), words(F.col(text)).alias("w"))
    d = d.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    rolled = [F.when(F.size("wh") >= k, F.transform(F.sequence(F.lit(0), F.size("wh") - k), _window_hash("wh", k))).otherwise(F.array().cast("array<bigint>")) for k in lens]
    # A text's words ride on its windows only where no window is shuffled.
    text_words = ["w"] if small else []
    # The outer form: for the inner one Spark would infer a filter that splits the text anew for each window.
    d = d.select("doc_id", "tag", *text_words, F.size("w").alias("n"), (F.concat(*rolled) if len(rolled) > 1 else rolled[0]).alias("hs"))
    d = d.select("doc_id", "tag", *text_words, "n", F.posexplode_outer("hs").alias("at", "h")).join(F.broadcast(win) if small else win.select("h", "len").distinct(), "h")
    # The windows of each length lie one after another; give the position within its length.
    before, ends = F.lit(0), F.lit(None).cast("int")
    for k in lens:
        here = F.greatest(F.lit(0), F.col("n") - (k - 1))
        ends = F.coalesce(ends, F.when(F.col("at") < before + here, F.when(F.col("len") == k, F.col("at") - before)))
        before = before + here
    d = d.withColumn("pos", ends)
    if small:
        d = d.filter(F.slice("w", F.col("pos") + 1, F.col("len")) == F.col("gram"))
    else:
        # Each text with a hit is read once more and gives the words of those windows, to be compared as a whole.
        at = d.filter(F.col("pos").isNotNull()).groupBy(F.col("doc_id").alias("h_id"), F.col("tag").alias("h_tag")).agg(F.collect_set(F.struct("pos", "len")).alias("at"))
        again = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))
        again = again.join(at, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tag") == F.col("h_tag"))).select("doc_id", "tag", "at", words(F.col("text")).alias("w"))
        own = F.transform("at", lambda s: F.struct(s["pos"].alias("pos"), s["len"].alias("len"), F.slice("w", s["pos"] + 1, s["len"]).alias("gram")))
        d = again.select("doc_id", "tag", own.alias("own")).select("doc_id", "tag", F.explode_outer("own").alias("o")).select("doc_id", "tag", "o.*").join(win.select("gram", "len", "items"), ["gram", "len"])
    return d.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("pos", "len")).alias("starts"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: words, hit words, items, and whether a twentieth or more of the words are hit."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tag"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    h = hits(docs, benchmark, doc_id, text, window)
    end = lambda s: s["pos"] + s["len"]
    covered = F.aggregate(F.array_sort("starts"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
                          lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), end(s) - F.greatest(a["upto"], s["pos"]))).alias("n"), F.greatest(a["upto"], end(s)).alias("upto")))["n"]
    h = h.select(F.col("doc_id").alias("h_id"), F.col("tag").alias("h_tag"), covered.cast("long").alias("n_hit"), "starts", F.array_sort("items").alias("items"))
    out = base.join(h, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tag") == F.col("h_tag")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "tag", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "starts", "items")


def remove_documents(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = report(docs, benchmark, doc_id, text, window).filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"))
    return docs.join(bad, F.col("__id").eqNullSafe(docs[doc_id]) & (F.col("__tag") == F.xxhash64(docs[text])), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, text) with the hit words, and what stands before them, taken out of the text."""
    r = report(docs, benchmark, doc_id, text, window).filter("n_hit > 0").select(F.col("doc_id").alias("h_id"), "tag", "starts").distinct()
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("d_tag"))
    letter, other = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
    d = d.join(r, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("d_tag") == F.col("tag")), "left")
    pieces = F.regexp_extract_all("text", F.lit(f"({other}*{letter}+)"), 1)
    d = d.withColumn("pieces", F.when(F.col("starts").isNotNull(), pieces))
    hit = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))))
    d = d.withColumn("hit", hit)
    left = F.array_join(F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), F.col("hit")).cast("array<string>"), ",")
    kept = F.array_join(F.transform(F.filter(F.split(left, ","), lambda i: i != ""), lambda i: F.get("pieces", i.cast("int"))), "")
    return d.select("doc_id", F.when(F.col("starts").isNull(), F.col("text")).otherwise(F.concat(kept, F.regexp_extract("text", f"({other}*)$", 1))).alias("text"))


SQL = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT item, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w)-least({WINDOW}, len(w))+2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
dw AS (SELECT rid, i, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w)-n+2)) AS i FROM d, (SELECT DISTINCT n FROM win) k WHERE len(w) >= n)),
h AS (SELECT rid, i, dw.n, item FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
p AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(i, i+n)) AS q FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
s AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20*coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN p USING (rid) LEFT JOIN s USING (rid)"""


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return report(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
