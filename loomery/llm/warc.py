"""WARC records as a chunked record table.

An archive is a table of (record_id, chunk) rows: chunk 0 carries the record's header, every row up to ``CHUNK``
bytes of payload and the digest of the payload so far. Oversized payloads are cut before they leave the JVM, so no
Python process holds a whole record, neither in writing nor in reading. ``export_files`` lays the table out as
``.warc`` files and ``read_files`` streams such files back into the table's form.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

CHUNK = 1 << 16
SCHEMA = "record_id string, chunk long, last boolean, header string, data binary, so_far string"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, n: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{n}')}>"


def _header(f, rid: str) -> str:
    revisit = f.record_type == "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {f.record_type}", f"WARC-Record-ID: {rid}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if f.url is not None:
        lines.append("WARC-Target-URI: " + "".join(f.url.split()))
    lines.append(f"WARC-Payload-Digest: sha1:{b32(f.sha1)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(int(f.first))}", f"X-Refers-To-Page: {int(f.first)}"]
    if f.page_id is not None and f.page_id == f.page_id:
        lines.append(f"X-Page: {int(f.page_id)}")
    lines += [f"X-Payload-Length: {f.bytes}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(_HTTP) + (0 if revisit else f.bytes)}"]
    return "\r\n".join(lines) + "\r\n\r\n" + _HTTP


def _written(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows are a page's chunks in order; the digest goes on from row to row, also over batches."""
    state = hashlib.sha1()
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            if r.chunk == 0:
                state = hashlib.sha1()
            data = bytes(r.data) if r.data is not None else b""
            state.update(data)
            rid = record_id(None if pd.isna(r.page_id) else int(r.page_id), int(r.copy))
            out.append((rid, r.chunk, r.last, _header(r, rid) if r.chunk == 0 else None, data, state.copy().hexdigest()))
        yield pd.DataFrame(out, columns=["record_id", "chunk", "last", "header", "data", "so_far"])


def deduplicated(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, sha1 (hex), bytes, first, record_type for each row of ``pages``."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    ids = materialize(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(body).alias("sha1"), F.length(body).cast("long").alias("bytes")), "ids")
    heads = ids.groupBy("sha1", "bytes").agg(F.min("page_id").alias("first"))
    out = ids.dropDuplicates().join(heads, ["sha1", "bytes"])
    again = (F.col("bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    often = ids.groupBy("page_id").agg(F.count("*").alias("rows")).where("rows > 1").withColumnRenamed("page_id", "q")
    out = out.join(often, F.col("page_id").eqNullSafe(F.col("q")), "left").drop("q")
    return out.withColumn("record_type", F.when(again, "revisit").otherwise("response"))


def archived(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) and returns the written archive table.

    Of equal payloads of at least ``min_bytes`` the smallest page_id is the response, others revisit it. Null html is
    an empty payload. Rows that share a page_id each get a record of its own id: equal ones equal types. A row without a page_id
    revisits an equal payload that has one. Other columns are ignored.
    """
    roles = deduplicated(pages, min_bytes).withColumnRenamed("page_id", "p")
    body = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("body"))
    rows = body.withColumn("s", F.sha1("body")).join(roles, (F.col("s") == F.col("sha1")) & F.col("page_id").eqNullSafe(F.col("p")))
    cut = F.expr(
        f"case when record_type = 'revisit' or bytes = 0 then array(cast('' as binary)) else "
        f"transform(sequence(0L, (bytes - 1) div {chunk}), i -> substring(body, int(i * {chunk} + 1), {chunk})) end"
    )
    rows = rows.select("page_id", "url", "sha1", "bytes", "first", "record_type", F.when(F.col("rows") > 1, F.monotonically_increasing_id() + 1).otherwise(0).alias("copy"), cut.alias("parts"))
    rows = rows.select("*", F.size("parts").alias("n"), F.posexplode("parts").alias("chunk", "data")).drop("parts")
    rows = rows.withColumn("last", F.col("chunk") == F.col("n") - 1).drop("n")
    return materialize(rows.mapInPandas(_written, SCHEMA), "archive")


def _streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of oversized records in order: their headers with the digest and length of what was read."""
    header, state, size = None, hashlib.sha1(), 0
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            if r.chunk == 0:
                header, state, size = r.header, hashlib.sha1(), 0
            state.update(bytes(r.data))
            size += len(r.data)
            if state.copy().hexdigest() != r.so_far:
                raise ValueError(f"chunk {r.chunk} of {r.record_id} differs from its digest")
            if r.last:
                out.append((header, state.hexdigest(), size))
        yield pd.DataFrame(out, columns=["header", "sha1", "size"])


def restored(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, from the archive's bytes.

    Digests and lengths of responses are those of the payload read; they must equal the header's, else the job fails.
    """
    whole = archive.where("chunk = 0 and last").select("header", F.sha1("data").alias("sha1"), F.length("data").cast("long").alias("size"))
    parts = archive.where("not (chunk = 0 and last)").repartition("record_id").sortWithinPartitions("record_id", "chunk")
    rows = whole.union(parts.mapInPandas(_streamed, "header string, sha1 string, size long"))
    of = lambda name: F.nullif(F.regexp_extract("header", rf"(?m)^{name}: (.*)$", 1), F.lit(""))
    rows = rows.select(of("X-Page").cast("long").alias("page_id"), of("WARC-Type").alias("record_type"), of("X-Payload-Length").cast("long").alias("payload_bytes"), of("WARC-Payload-Digest").alias("claimed"), of("X-Refers-To-Page").cast("long").alias("refers_to"), "sha1", "size")
    digest = F.expr("""concat('sha1:', array_join(flatten(transform(sequence(0, 7), i -> transform(array(15, 10, 5, 0), b ->
        substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', int(shiftright(cast(conv(substring(sha1, 5 * i + 1, 5), 16, 10) as int), b) % 32) + 1, 1)))), ''))""")
    good = (F.col("record_type") == "revisit") | ((digest == F.col("claimed")) & (F.col("size") == F.col("payload_bytes")))
    return rows.select(
        "page_id",
        "payload_bytes",
        F.when(good, F.substring("claimed", 6, 32)).otherwise(F.raise_error(F.concat(F.lit("a payload differs from its header: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def export_files(archive: DataFrame, folder: str) -> None:
    """Lays ``archive`` out as .warc files in ``folder``, a path that all executors share; chunk by chunk."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        name = os.path.join(folder, f"part-{uuid.uuid4().hex}.warc")
        with open(name + ".tmp", "wb") as out:
            for f in frames:
                for r in f.itertuples(index=False):
                    out.write((r.header.encode() if r.chunk == 0 else b"") + bytes(r.data) + (b"\r\n\r\n" if r.last else b""))
        os.rename(name + ".tmp", name)  # a task that is lost leaves no archive
        yield pd.DataFrame({"file": [name]})

    archive.repartition("record_id").sortWithinPartitions("record_id", "chunk").mapInPandas(run, "file string").count()


def _read(path: str, chunk: int) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while line := f.readline():
            if not line.strip():
                continue
            head = [line]
            while (line := f.readline()) not in (b"\r\n", b""):
                head.append(line)
            fields = dict(x.decode().rstrip("\r\n").split(": ", 1) for x in head[1:])
            http = f.read(len(_HTTP))
            left, n, state = int(fields["Content-Length"]) - len(http), 0, hashlib.sha1()
            while True:
                data = f.read(min(chunk, left))
                left -= len(data)
                state.update(data)
                yield fields["WARC-Record-ID"], n, not left, (b"".join(head) + b"\r\n" + http).decode() if n == 0 else None, data, state.copy().hexdigest()
                n += 1
                if not left:
                    break


def read_files(spark: SparkSession, paths: list[str], chunk: int = CHUNK) -> DataFrame:
    """The chunk table of .warc files on a path that all executors share, one file a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["path"]:
                for row in _read(path, chunk):
                    yield pd.DataFrame([row], columns=["record_id", "chunk", "last", "header", "data", "so_far"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInPandas(run, SCHEMA)
