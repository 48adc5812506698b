"""Quality rules as a ledger of failure bits (native: DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps the measurements
and one failure bit per rule; a policy is a versioned mask of bits, so policies
and ablations are bitwise work on the ledger and never touch the text again.

Words are runs of characters other than space and U+0009 to U+000D. Null and
empty texts have no words, fail ``few_words`` and are kept as rows. Repeated
rows give repeated rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the measurements of every whole text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"))
    trimmed = F.btrim("t", F.lit(" \t\n\x0b\x0c\r"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.select("doc_id", F.when(trimmed != "", F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>")).alias("words"),
                 F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                 F.length(F.regexp_replace("t", "[^!]+", "")).cast("long").alias("n_shouts"), lines.alias("lines"))
    n = F.size("words")
    d = d.select("doc_id", "n_symbols", "n_shouts", n.cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                 F.transform("words", lambda w: F.xxhash64(w)).alias("wh"))
    window = lambda i: F.xxhash64(*[F.get("wh", i + k) for k in range(WINDOW)])
    d = d.withColumn("keys", F.when(F.col("n_words") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("wh") - WINDOW), window))).drop("wh")
    # Only a text with some window twice needs its windows sorted.
    twice = F.size(F.array_distinct("keys")) < F.size("keys")
    d = d.withColumn("ranked", F.when(twice, F.array_sort(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i")))))).drop("keys")
    same = lambda x, j: F.coalesce(F.get("ranked", j)["k"] == x["k"], F.lit(False))
    d = d.withColumn("starts", F.sort_array(F.transform(F.filter("ranked", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))).drop("ranked")
    covered = F.aggregate("starts", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                          lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n"), s.alias("last")))["n"]
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_shouts", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


#: (name, failure) in the order of their bits; whole numbers only, so every engine decides alike.
RULES: list[tuple[str, Column]] = [
    ("few_words", lambda: F.col("n_words") < 10),
    ("repeated_words", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    ("repeated_lines", lambda: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
    ("many_symbols", lambda: 10 * F.col("n_symbols") > 5 * F.col("n_words")),
    ("many_shouts", lambda: 10 * F.col("n_shouts") > 5 * F.col("n_words")),
    ("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    ("long_words", lambda: F.col("word_chars") > 20 * F.col("n_words")),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: version -> mask of the rules that reject a document.
POLICIES = {1: BIT["few_words"] | BIT["repeated_words"], 2: sum(BIT.values())}


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measurements and ``failed``, the bits of the rules that a document fails."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(rule(), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")) for name, rule in RULES])
    return measures(docs, doc_id, text).withColumn("failed", bits)


def apply_policy(led: DataFrame, version: int = 2, policies: dict[int, int] = POLICIES) -> DataFrame:
    """``kept``: no bit of the policy's mask is set."""
    return led.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policies[version]).cast("long")) == 0)


def ablations(led: DataFrame, version: int = 2, policies: dict[int, int] = POLICIES) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects; one aggregate pass."""
    mask = policies[version]
    within = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    names = [n for n in BIT if BIT[n] & mask]
    counted = led.agg(F.count("*").alias("n_docs"), *[F.count_if(within.bitwiseAND(F.lit(BIT[n]).cast("long")) != 0).alias(f"f_{n}") for n in names],
                      *[F.count_if(within == BIT[n]).alias(f"o_{n}") for n in names])
    return counted.select("n_docs", F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only")) for n in names])))


SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text,'') AS t FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  length(regexp_replace(t, '[^!]', '', 'g')) AS n_shouts, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM (SELECT rid, unnest(range(1, len(words)-{WINDOW - 2})) AS i,
  unnest(list_transform(range(1, len(words)-{WINDOW - 2}), lambda j: array_to_string(words[j:j+{WINDOW - 1}], ' '))) AS k FROM w)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i+{WINDOW})) AS p FROM g WHERE c >= 2) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_shouts,
  len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 10 OR 100*n_repeat_words > 20*n_words AS base_failed, 10*n_dup_lines > 3*n_lines OR 10*n_symbols > 5*n_words OR 10*n_shouts > 5*n_words
  OR word_chars < 2*n_words OR word_chars > 20*n_words AS more FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT more AS kept FROM f"""


def query(docs: DataFrame) -> DataFrame:
    led = apply_policy(ledger(docs))
    base = F.col("failed").bitwiseAND(F.lit(POLICIES[1]).cast("long")) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")
