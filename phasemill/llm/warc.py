"""WARC archives through a chunked record table.

A payload never travels whole: records become rows (record, chunk number, chunk of
``CHUNK`` bytes), and digests are carried from chunk to chunk. The writer streams
the chunk rows of a record into the archive, one gzip member per record; the
reader streams the archives in blocks and yields chunk rows again, or one row per
record with the digest of what it read.

Of records with equal payloads of ``revisit_from`` bytes or more, the one with the
largest id is the response, the others are revisits without payload that name it
and the payload's digest and length. Of repeated rows with that id one is the
response. A null payload is empty. A null id is the smallest id and written as
``null``; a revisit of it refers to null. An empty table gives no archive. Other
columns are ignored.

Tasks write under names of their own attempt; the list of archives holds what
finished tasks report, so a lost or repeated attempt leaves at most an unlisted
file. The reader fails if a payload does not have the digest its header states.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasemill.llm.common import stored
from phasemill.session import scratch_path

CHUNK, BLOCK, ARCHIVE = 1 << 16, 1 << 20, 1 << 30


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, a bare path being on the session's default one as Spark reads it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def chunked(records: DataFrame, record_id: str, uri: str, payload: str, chunk: int = CHUNK) -> DataFrame:
    """(row, id, uri, chunk_no, n_chunks, chunk): every record as rows of at most ``chunk`` bytes, in order."""
    r = records.select(F.col(record_id).cast("long").alias("id"), F.col(uri).cast("string").alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    r = r.withColumn("row", F.monotonically_increasing_id()).withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk)).cast("int"))
    r = r.select("row", "id", "uri", "n_chunks", "payload", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_no"))
    return r.select("row", "id", "uri", "chunk_no", "n_chunks", F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("chunk"))


def digests(chunks: DataFrame) -> DataFrame:
    """(row, id, payload_bytes, digest) of each record, carried over its chunks; rows must be in the table's order."""

    def each(batches):
        sha, size = hashlib.sha1(), 0
        for batch in batches:
            rows, ids, sizes, sums = [], [], [], []
            c = batch.to_pydict()
            for row, i, no, n, chunk in zip(c["row"], c["id"], c["chunk_no"], c["n_chunks"], c["chunk"]):
                if no == 0:
                    sha, size = hashlib.sha1(), 0
                sha.update(chunk)
                size += len(chunk)
                if no == n - 1:
                    rows.append(row), ids.append(i), sizes.append(size), sums.append(sha.digest())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.binary())], ["row", "id", "payload_bytes", "digest"])

    return chunks.select("row", "id", "chunk_no", "n_chunks", "chunk").mapInArrow(each, "row long, id long, payload_bytes long, digest binary")


def roles(heads: DataFrame, revisit_from: int = 0) -> DataFrame:
    """(id, payload_bytes, digest, target) once per id and payload; target is the largest id with that payload."""
    largest = heads.groupBy("digest", "payload_bytes").agg(F.max("id").alias("target"))
    once = heads.groupBy("id", "digest", "payload_bytes").agg(F.lit(1).alias("one")).drop("one")
    out = once.join(largest, ["digest", "payload_bytes"])
    return out.withColumn("alone", F.col("payload_bytes") < revisit_from).select("id", "payload_bytes", "digest", "target", "alone")


class _Archive:
    """A WARC file that grows record by record."""

    def __init__(self, folder: str):
        self.fs, base = _open(folder)
        self.fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        self.path = f"{folder}/{name}"
        self.out, self.records, self.member = self.fs.open_output_stream(f"{base}/{name}", compression=None), 0, None

    def begin(self, headers: list[tuple[str, str]]) -> None:
        self.member = zlib.compressobj(6, wbits=31)
        self.write(("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode())

    def write(self, data: bytes) -> None:
        self.out.write(self.member.compress(data))

    def end(self) -> None:
        self.write(b"\r\n\r\n")
        self.out.write(self.member.flush())
        self.records += 1


def _headers(i, uri, size: int, digest: bytes, target, response: bool) -> list[tuple[str, str]]:
    name = lambda x: f"<urn:record:{'null' if x is None else x}>"
    line = (uri or "").replace("\r", "%0D").replace("\n", "%0A")
    out = [("WARC-Type", "response" if response else "revisit"), ("WARC-Record-ID", name(i)), ("WARC-Target-URI", line), ("WARC-Payload-Digest", f"sha1:{base32(digest)}"),
           ("Content-Length", str(size if response else 0)), ("X-Payload-Length", str(size))]
    return out if response else [*out, ("WARC-Refers-To", name(target)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]


def write(records: DataFrame, folder: str, record_id: str, uri: str, payload: str, revisit_from: int = 0, chunk: int = CHUNK, archive: int = ARCHIVE) -> DataFrame:
    """Write archives of about ``archive`` payload bytes into ``folder``; returns their list (path, records).

    ``records`` is read twice and must come in the same order both times, as stored
    tables do; the writer digests what it writes again and fails otherwise.
    """
    folder = qualified(records.sparkSession, folder)
    heads = stored(digests(chunked(records, record_id, uri, payload, chunk)), "warc-heads")
    role = roles(heads, revisit_from)
    chunks = chunked(records, record_id, uri, payload, chunk)
    # The payload's digest is not known to its chunks, so what tells records of one id apart is their row.
    plan = heads.select(F.col("row"), "id", "digest", "payload_bytes").join(role.select(F.col("id").alias("r_id"), "digest", "payload_bytes", "target", "alone"), ["digest", "payload_bytes"]) \
        .filter(F.col("id").eqNullSafe(F.col("r_id"))).select("row", "digest", "payload_bytes", "target", "alone")
    first = heads.groupBy("id", "digest", "payload_bytes").agg(F.min("row").alias("first")).select(F.col("first").alias("row"), F.lit(True).alias("first"))
    plan = plan.join(first, "row", "left").withColumnRenamed("row", "p_row")
    # One shuffle brings the chunks of a record together; only a response needs its bytes.
    dealt = chunks.repartition(F.col("row")).join(plan, F.col("row") == F.col("p_row"))
    response = F.col("alone") | (F.col("first").isNotNull() & F.col("id").eqNullSafe(F.col("target")))
    dealt = dealt.withColumn("response", response).filter(F.col("response") | (F.col("chunk_no") == 0))
    dealt = dealt.withColumn("chunk", F.when(F.col("response"), F.col("chunk"))).sortWithinPartitions("row", "chunk_no")
    columns = ["id", "uri", "chunk_no", "n_chunks", "payload_bytes", "digest", "target", "response", "chunk"]

    def each(batches):
        out, written, expected, sha = None, 0, 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk_no"] != (expected if r["response"] else 0):
                    raise RuntimeError(f"record {r['id']}: chunk {r['chunk_no']} where {expected} was due")
                if r["chunk_no"] == 0:
                    if out is not None and written >= archive:
                        out.out.close()
                        yield pa.RecordBatch.from_arrays([pa.array([out.path]), pa.array([out.records], pa.int64())], ["path", "records"])
                        out, written = None, 0
                    out = out or _Archive(folder)
                    out.begin(_headers(r["id"], r["uri"], r["payload_bytes"], r["digest"], r["target"], r["response"]))
                    sha = hashlib.sha1()
                if r["response"]:
                    out.write(r["chunk"])
                    sha.update(r["chunk"])
                    written += len(r["chunk"])
                expected = r["chunk_no"] + 1 if r["response"] and r["chunk_no"] < r["n_chunks"] - 1 else 0
                if not expected:
                    out.end()
                    if r["response"] and sha.digest() != r["digest"]:
                        raise RuntimeError(f"record {r['id']} is not what was digested: the records must be a stored table, read in one order")
        if out is not None:
            out.out.close()
            yield pa.RecordBatch.from_arrays([pa.array([out.path]), pa.array([out.records], pa.int64())], ["path", "records"])

    return stored(dealt.select(columns).mapInArrow(each, "path string, records long"), "warc-list")


def _members(stream):
    """The decompressed blocks of each gzip member of a file, as one iterator per member."""
    rest = b""

    def member(engine):
        nonlocal rest
        data = rest
        rest = b""
        while not engine.eof:
            if not data:
                data = stream.read(BLOCK)
                if not data:
                    raise RuntimeError("an archive ends within a record")
            block = engine.decompress(data, BLOCK)
            data = engine.unconsumed_tail
            if block:
                yield block
        rest = engine.unused_data

    while True:
        if not rest:
            rest = stream.read(BLOCK)
        if not rest:
            return
        yield member(zlib.decompressobj(wbits=31))


def _records(fs: pafs.FileSystem, path: str):
    """(headers, iterator over the payload's blocks) of every record of one archive."""
    with fs.open_input_stream(path, compression=None) as stream:
        for blocks in _members(stream):
            head = b""
            while b"\r\n\r\n" not in head:
                head += next(blocks)
            head, _, body = head.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])

            def payload(body=body, blocks=blocks, left=int(headers["Content-Length"])):
                for block in [body, None]:
                    if block is not None:
                        if left and block:
                            yield block[:left]
                            left -= min(left, len(block))
                    else:
                        for more in blocks:
                            if left:
                                yield more[:left]
                                left -= min(left, len(more))

            yield headers, payload()


def read(spark: SparkSession, archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the listed archives, read as streams.

    (id, uri, payload_bytes, payload_digest, record_type, refers_to) once per record;
    with ``payloads`` a row per chunk, with chunk_no and chunk, the digest on the last.
    """

    def each(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, own = _open(path)
                rows: list[tuple] = []
                held = 0
                for headers, blocks in _records(fs, own):
                    sha, size, no = hashlib.sha1(), 0, 0
                    number = lambda k: None if k not in headers or "null" in headers[k] else int(headers[k].strip("<>").rsplit(":", 1)[1])  # noqa: E731, B023
                    base = (number("WARC-Record-ID"), headers["WARC-Target-URI"])
                    kind, refers = headers["WARC-Type"], number("WARC-Refers-To")
                    for block in blocks:
                        sha.update(block)
                        size += len(block)
                        if payloads:
                            rows.append((*base, None, None, kind, refers, no, block))
                            held, no = held + len(block), no + 1
                            if held > 16 * BLOCK:
                                yield _batch(rows, payloads)
                                rows, held = [], 0
                    stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (base32(sha.digest()) != stated or size != int(headers["X-Payload-Length"])):
                        raise RuntimeError(f"{path}: record {base[0]} does not have the digest {stated}")
                    rows.append((*base, int(headers["X-Payload-Length"]), stated, kind, refers, no, b""))
                    if len(rows) >= 10_000:
                        yield _batch(rows, payloads)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, payloads)

    kind = "id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # As many tasks as archives: a number is kept, where a key's small rows would be merged into few tasks.
    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(each, kind + (", chunk_no int, chunk binary" if payloads else ""))


FIELDS = [("id", pa.int64()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("chunk", pa.binary())]


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    fields = FIELDS if payloads else FIELDS[:6]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS target FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda j: array_to_string(list_transform(range(0, 4),
  lambda k: substr('{_ALPHABET}', CAST((CAST(concat('0x', substr(h, CAST(1+5*j AS INTEGER), 5)) AS BIGINT) >> (15-5*k)) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> target THEN target END AS refers_to FROM m"""


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    archives = write(pages, scratch_path(spark, "warc"), "page_id", "url", "html")
    return read(spark, archives).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
