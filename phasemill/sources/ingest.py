"""Scans and sinks with contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasemill.session import cut_lineage

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def pinned(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet under a declared schema; nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def snapshot(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Several part folders as one table."""
    return spark.read.schema(schema).parquet(*paths)


def immutable(df: DataFrame, path: str, *, files: int | None = None) -> None:
    """Write once; an existing target is an error. ``files`` spreads rows before the write, so work upstream keeps its parallelism."""
    (df.repartition(files) if files else df).write.mode("errorifexists").parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def _seal(df: DataFrame) -> list[Column]:
    """A record set's count and the sum of its row hashes: equal for equal rows in any order."""
    return [F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest")]


def written_and_checked(df: DataFrame, path: str) -> DataFrame:
    """Write, read back and compare counts and digests; one row with the verdict.

    What was computed is observed while it is written, so the plan runs once.
    """
    seen = Observation("written")
    immutable(df.observe(seen, *_seal(df)), path)
    rows, digest = seen.get["rows"], seen.get["digest"]
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    same = F.col("rows").eqNullSafe(F.lit(rows)) & F.col("digest").eqNullSafe(F.lit(digest).cast("decimal(38,0)"))
    return back.agg(*_seal(back)).select(F.lit(rows).cast("bigint").alias("computed"), F.col("rows").alias("written"), same.alias("contract_ok"))


def manifest_to_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType, key: str, *,
                        declared_rows: int | None = None, constants: dict[str, object] | None = None) -> DataFrame:
    """JSON lines to a sorted Parquet table; one aggregate decides whether it may be written.

    Every field must be filled, keys must be unique, the number of rows must be the declared one and each column
    of ``constants`` (such as the part or the checksum of the source) must hold its value in every row.
    """
    df = spark.read.schema(schema).json(source)
    constants = constants or {}
    empty = F.lit(False)
    for c in schema.names:
        empty = empty | F.col(c).isNull()
    # By key first, so that counts combine before they are shuffled and no task sees all rows.
    other = [F.count_if(~F.col(c).eqNullSafe(F.lit(v))).alias(f"_{i}") for i, (c, v) in enumerate(constants.items())]
    keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c"), F.count_if(empty).alias("_empty"), *other)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    found = keys.agg(total("_c").alias("rows"), total("_empty").alias("empty"), F.count_if(F.col("_c") > 1).alias("copies"),
                     *[total(f"_{i}").alias(f"other_{c}") for i, c in enumerate(constants)]).head()
    broken = []
    if declared_rows is not None and found["rows"] != declared_rows:
        broken.append(f"{found['rows']} rows, declared {declared_rows}")
    if found["empty"]:
        broken.append(f"{found['empty']} rows with a null field")
    broken += [f"{found[f'other_{c}']} rows of another {c}" for c in constants if found[f"other_{c}"]]
    if found["copies"]:
        broken.append(f"{found['copies']} duplicate keys")
    if broken:
        raise ValueError("manifest contract: " + "; ".join(broken))
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").parquet(target)
    return spark.read.schema(schema).parquet(target)


#: A quoted field, and a comma that is not inside one.
QUOTED, BARE_COMMA = '"(?:[^"]|"")*"', ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def csv_with_preamble(lines: DataFrame, columns: list[str], *, sep: str = ",") -> DataFrame:
    """Rows of an export with ``#`` comments and blank lines: the header is dropped, a ragged row gets a reason.

    ``lines`` is (ordinal, value); html, a byte-order mark and quoted fields as exported. An empty field is null.
    """
    value = F.regexp_replace("value", "^﻿", "")
    x = lines.withColumn("value", value).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_corrupt"]])
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    x = x.withColumn("_p", F.from_csv("value", schema.simpleString()[len("struct<"):-1].replace(":", " "), options))
    header = F.array(*[F.col("_p")[c] for c in columns]) == F.array(*[F.lit(c) for c in columns])
    reason = (F.when(F.lower("value").startswith("<"), "html").when(F.col("_p._corrupt").isNotNull(), "ragged").when(F.coalesce(header, F.lit(False)), "header"))
    return x.select("ordinal", reason.alias("reason"), *[F.col("_p")[c].alias(c) for c in columns])


def inspected_exports(lines: DataFrame, required: list[str]) -> DataFrame:
    """The structure of each export, one row each: header, rows, preamble and the first broken rule (null: none).

    ``lines`` is (export, ordinal, value) with the ordinals of an export distinct. The header is the first line that
    is neither blank nor a ``#`` comment; after it only empty lines are skipped. Quoted fields may hold commas but
    no line breaks. Rules in order: html_or_xml_response, invalid_csv_header, missing_columns, inconsistent_csv_width,
    empty_export.
    """
    x = lines.withColumn("value", F.regexp_replace("value", "^﻿", ""))
    text = F.trim("value")
    told = (text != "") & ~text.startswith("#")
    first = x.groupBy("export").agg(F.min_by("value", F.when(told, F.col("ordinal"))).alias("header"), F.min(F.when(told, F.col("ordinal"))).alias("_at"))
    name = F.transform(F.split("header", BARE_COMMA), lambda c: F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"'))
    first = first.withColumn("columns", F.coalesce(name, F.array().cast("array<string>")))
    outside = F.regexp_replace("value", QUOTED, "")
    width = F.length(outside) - F.length(F.regexp_replace(outside, ",", "")) + 1
    row = (F.col("ordinal") > F.col("_at")) & (F.col("value") != "")
    facts = x.join(first.select("export", "_at", F.size("columns").alias("_n")), "export").groupBy("export").agg(
        F.count_if(row).alias("row_count"), F.count_if(row & (width != F.col("_n"))).alias("_ragged"), F.count_if(F.col("ordinal") < F.col("_at")).alias("preamble_lines"))
    x = first.join(facts, "export")
    names = F.col("columns")
    bad = (F.size(names) < 2) | F.exists(names, lambda c: F.trim(c) == "") | (F.size(F.array_distinct(names)) != F.size(names))
    absent = F.array_sort(F.array_except(F.array(*[F.lit(c) for c in required]), names))
    reason = (F.when(F.ltrim("header").startswith("<"), "html_or_xml_response").when(F.col("header").isNull() | bad, "invalid_csv_header")
              .when(F.size(absent) > 0, F.concat(F.lit("missing_columns:"), F.array_join(absent, ","))).when(F.col("_ragged") > 0, "inconsistent_csv_width")
              .when(F.col("row_count") == 0, "empty_export"))
    return x.select("export", "columns", "row_count", "preamble_lines", reason.alias("reason"))


def close_runs(runs: DataFrame, path: str, keys: list[str], *, code: Column, stage: str) -> None:
    """Write one summary row per run and, for a run with a ``code``, a terminal marker beside the summaries.

    A marker says that the contract failed by itself, so trying again is of no use; both are written once.
    """
    runs = cut_lineage(runs.withColumn("error_code", code))
    json_lines(runs.withColumn("contract_ok", F.col("error_code").isNull()), f"{path}/summary")
    marker = runs.filter("error_code IS NOT NULL").select(*keys, F.lit("data_contract").alias("failure_type"), F.lit(stage).alias("error_stage"), "error_code")
    json_lines(marker, f"{path}/_TERMINAL")


def verified_blobs(blobs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each (key, content) against its manifest row: unknown, size_mismatch, digest_mismatch or ok."""
    x = blobs.select("key", F.octet_length("content").cast("bigint").alias("size"), F.sha2(F.col("content"), 256).alias("sha"))
    x = x.join(manifest, "key", "left")
    code = (F.when(F.col("size_bytes").isNull(), "unknown_key").when(F.col("size") != F.col("size_bytes"), "size_mismatch")
            .when(F.col("sha") != F.col("sha256"), "digest_mismatch").otherwise("ok"))
    return x.select("key", "size", "sha", code.alias("code"))


def parsed_sources(lines: DataFrame) -> DataFrame:
    """(name, id, uri) of download-script lines, with the reason a line is rejected."""
    pattern = r"^curl -o (\S+)-([0-9]+)\.html (https?://\S+)$"
    at = lambda i: F.regexp_extract("value", pattern, i)
    x = lines.select("value", at(1).alias("name"), at(2).alias("ident"), at(3).alias("uri"))
    copies = x.filter("uri <> ''").groupBy("uri").agg(F.count(F.lit(1)).alias("_c"))
    x = x.join(copies, "uri", "left")
    return x.select("name", "ident", "uri", F.when(F.col("uri") == "", "malformed").when(F.col("_c") > 1, "duplicate").otherwise("ok").alias("status"))


def first_bundle(df: DataFrame, bundle: str, key: str, count: int) -> DataFrame:
    """The first ``count`` keys of the first bundle, with all their rows: a canary run."""
    low = df.agg(F.min(bundle).alias(bundle))
    keys = df.join(F.broadcast(low), bundle, "left_semi").select(key).distinct().orderBy(key).limit(count)
    return df.join(F.broadcast(keys), key, "left_semi")


def download_audit(expected: DataFrame, log: DataFrame) -> DataFrame:
    """Latest logged state of each expected file against its checksum."""
    last = log.groupBy("file").agg(F.max_by(F.struct("state", "checksum"), "seq").alias("e"))
    x = expected.join(last, "file", "left")
    why = (F.when(F.col("e").isNull(), "not_attempted").when(F.col("e.state") != "VALIDATED", "not_validated")
           .when(F.col("e.checksum") != F.col("want"), "checksum_mismatch").otherwise("ok"))
    return x.select("file", why.alias("reason"))


def coverage(expected: DataFrame, actual: DataFrame, part: str, key: str, size: str) -> DataFrame:
    """Per part: missing and extra keys, bytes on both sides and whether the part agrees."""
    e = expected.groupBy(part, key).agg(F.sum(size).alias("_e"))
    a = actual.groupBy(part, key).agg(F.sum(size).alias("_a"))
    x = e.join(a, [part, key], "full_outer").groupBy(part).agg(
        F.count_if(F.col("_a").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("extra"),
        F.coalesce(F.sum("_e"), F.lit(0)).alias("expected_bytes"), F.coalesce(F.sum("_a"), F.lit(0)).alias("actual_bytes"))
    return x.withColumn("agrees", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("expected_bytes") == F.col("actual_bytes")))
