"""WARC archives as a chunked record table.

Writing: each task streams its pages into one gzip-per-record archive in the shared
folder, under a name of its own that is renamed when complete, so a task that is run
again replaces nothing half written.  The first page (smallest id) of equal payloads
of at least ``MIN_REVISIT`` bytes is a ``response``, the others are ``revisit`` records
without a body that name it.

Reading: a record is never held whole.  The archive is inflated piece by piece and
every record becomes rows ``(record id, chunk number, data)`` of at most ``CHUNK``
bytes; SHA-256 and byte count go along incrementally and stand on the last chunk.
Rows of one record are adjacent in their archive but need not stay together, so
an oversized payload is no oversized row.  Revisits hold the digest and length that
their header says.

Edge cases: a null or empty payload is a response of 0 bytes with the digest of
nothing; equal rows (same id, same payload) that share the smallest id are all
responses; null ids are written as an empty id and read back as null, and never
count as the smallest unless all ids are null (then all are responses); an empty
table writes no record and reads back empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.session import new_path, small_batches, stash, table, trimmed

MIN_REVISIT = 100
BROADCAST_ROWS = 300_000
READERS = 20_000
CHUNK = 1 << 20
READ = 1 << 16
CHUNK_SCHEMA = "archive string, record_id string, page_id long, record_type string, refers_to long, chunk int, n_bytes long, data binary, last boolean, payload_bytes long, payload_digest string"


def _header(page_id: int | None, kind: str, refers_to: int | None, length: int, payload_bytes: int, digest: str) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{kind}')}>",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {payload_bytes}",
        "Content-Type: text/html",
        f"Content-Length: {length}",
    ]
    if refers_to is not None:
        lines.insert(3, f"X-Refers-To-Page-ID: {refers_to}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def classify(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(page_id, html, payload_bytes, payload_digest, record_type, refers_to)``; ``html`` is null for revisits.

    The smallest id of a digest is found by partial aggregation of ids alone.  Up to
    ``broadcast_rows`` digests that repeat are broadcast, so no payload is moved; beyond
    that the revisits are named by joins of narrow rows and payloads meet them by id and
    digest, a key that copies don't share.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "html", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"))
    narrow = rows.where(F.col("payload_bytes") >= MIN_REVISIT).select("page_id", F.col("payload_digest").alias("__digest"))
    repeats = narrow.groupBy("__digest").agg(F.min("page_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1 AND __first IS NOT NULL").drop("__n")
    repeats = stash(repeats, "warc-repeats")
    same = F.col("payload_digest") == F.col("__digest")
    if repeats.count() <= broadcast_rows:
        named = rows.join(F.broadcast(repeats), same, "left")
    else:
        again = narrow.join(repeats, "__digest").where(~F.col("page_id").eqNullSafe(F.col("__first"))).withColumnRenamed("page_id", "__page").distinct()
        named = rows.join(stash(again, "warc-revisits"), same & F.col("page_id").eqNullSafe(F.col("__page")), "left").drop("__page")
    again = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return named.select(
        "page_id", F.when(~again, F.col("html")).alias("html"), "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("__first")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per task into ``folder`` (a URI); returns ``(archive, records, bytes)``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}.warc.gz"
        out, n, size = None, 0, 0
        for batch in batches:
            columns = [batch.column(k) for k in ("page_id", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")]
            for row in zip(*columns, strict=True):
                page_id, html, payload_bytes, digest, kind, refers_to = (x if k == 1 else x.as_py() for k, x in enumerate(row))
                if out is None:
                    out = store.open_output_stream(name + ".part", compression=None)
                body = memoryview(html.as_buffer()) if html.is_valid and kind == "response" else memoryview(b"")
                deflate = zlib.compressobj(1, zlib.DEFLATED, 31)  # a gzip member for each record
                size += out.write(deflate.compress(_header(page_id, kind, refers_to, len(body), payload_bytes, digest)))
                for k in range(0, len(body), CHUNK):
                    size += out.write(deflate.compress(body[k : k + CHUNK]))
                size += out.write(deflate.compress(b"\r\n\r\n")) + out.write(deflate.flush())
                n += 1
        if out is not None:
            out.close()
            store.move(name + ".part", name)
            yield pa.RecordBatch.from_pylist([{"archive": name, "records": n, "bytes": size}])

    return records.select("page_id", "html", "payload_bytes", "payload_digest", "record_type", "refers_to").mapInArrow(trimmed(write), "archive string, records long, bytes long")


def _inflated(stream: pa.NativeFile) -> Iterator[bytes]:
    """The archive's bytes, member after member, in bounded pieces."""
    inflate = zlib.decompressobj(31)
    left = b""
    while True:
        data = left or stream.read(READ)
        left = b""
        if not data:
            return
        piece = inflate.decompress(data, CHUNK)
        if piece:
            yield piece
        if inflate.eof:
            left, inflate = inflate.unused_data, zlib.decompressobj(31)
        else:
            left = inflate.unconsumed_tail


def _records(stream: pa.NativeFile, chunk: int) -> Iterator[tuple[dict, int, bytes, bool, int, str]]:
    """``(header, chunk number, data, is last, bytes so far, digest so far or "")``."""
    pieces, held = _inflated(stream), b""

    def more() -> bool:
        nonlocal held
        piece = next(pieces, None)
        if piece is None:
            return False
        held += piece
        return True

    while True:
        while b"\r\n\r\n" not in held:
            if not more():
                if held.strip():
                    raise ValueError("an archive ends inside a record's header")
                return
        head, _, held = held.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        todo, sha, done, k = int(fields["Content-Length"]), hashlib.sha256(), 0, 0
        while True:
            while len(held) < min(todo, chunk):
                if not more():
                    raise ValueError("an archive ends inside a record's payload")
            data, held = held[: min(todo, chunk)], held[min(todo, chunk) :]
            todo -= len(data)
            done += len(data)
            sha.update(data)
            yield fields, k, data, not todo, done, sha.hexdigest() if not todo else ""
            k += 1
            if not todo:
                break
        while len(held) < 4:
            if not more():
                raise ValueError("an archive ends inside a record")
        held = held[4:]


def read_chunks(archives: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives named in ``archives.archive``, each read by one
    task (by name, four tasks for each archive up to ``READERS``, so that few share one).

    ``payload_bytes`` and ``payload_digest`` stand on a record's last chunk: computed
    from what was read for a response, and the header's for a revisit.  A response
    whose digest isn't its header's raises an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for fields, k, data, last, done, digest in _records(stream, chunk):
                        kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if last and kind == "response" and said != digest:
                            raise ValueError(f"payload digest of {fields['WARC-Record-ID']} differs")
                        total = done if kind == "response" else int(fields["X-Payload-Length"])
                        rows.append(
                            {
                                "archive": name, "record_id": fields["WARC-Record-ID"].strip("<>"), "page_id": int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, "record_type": kind,
                                "refers_to": int(fields["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in fields else None,
                                "chunk": k, "n_bytes": len(data), "data": data, "last": last, "payload_bytes": total if last else None, "payload_digest": said if last else None,
                            }
                        )
                        size += len(data) + 200
                        if size >= 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    tasks = max(1, min(4 * archives.count(), READERS))
    return archives.select("archive").repartition(tasks, "archive").mapInArrow(trimmed(read), CHUNK_SCHEMA)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table, from its last chunk: what the header says, the chunks,
    and the bytes and digest carried along."""
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("chunk") + 1).alias("chunks"))


SCHEMA = pa.schema(
    [("archive", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int32()), ("n_bytes", pa.int64()), ("data", pa.binary()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)


def archive_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Classifies and writes ``pages``; returns the archives written (a table in the shared folder).

    The list of archives is written only by tasks that ended well, so archives of
    lost attempts are never read.
    """
    small_batches(pages.sparkSession)
    return stash(write_archives(classify(pages), folder), "warc-archives")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    folder = new_path(spark, "warc")
    return records(read_chunks(archive_pages(table(spark, sf_dir, "pages"), folder), folder))


OP6_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT} AND page_id <> first THEN first END AS refers_to,
       CAST(CASE WHEN n >= {MIN_REVISIT} AND page_id <> first THEN 1 ELSE greatest(1, ceil(n / {CHUNK}.0)) END AS INTEGER) AS chunks
FROM f
"""
