"""Web archives: pages to WARC records, and records back as a table of chunks.

Equal payloads are stored once. Of the pages that share one, the page with the
largest id becomes a response, the others revisit it. Payloads are written and
read in pieces of ``CHUNK`` bytes: a record of any size is a run of rows
``(record_id, chunk_no)``, each with the size and SHA-1 of the payload up to there,
so nothing holds a whole record and the last row has the digest of all.

Files go to the folder all executors share, named by attempt and listed in a
stored manifest. A task that runs again writes other files; those that no manifest
names are never read. A page's html is shuffled once, by page and digest, so a
payload on a third of all pages is no hot key.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.durable import durable, new_folder, stored

CHUNK = 1 << 20
FILE_BYTES = 1 << 29  # a file is closed once it is this large
_URN = "urn:thicket:page:"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNKS = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
        ("refers_to_id", pa.string()), ("stored_digest", pa.string()), ("stored_bytes", pa.int64()),
        ("chunk_no", pa.int32()), ("data", pa.binary()), ("bytes_so_far", pa.int64()),
        ("digest_so_far", pa.string()), ("last", pa.bool_()),
    ]
)
_CHUNKS_SQL = (
    "record_id string, record_type string, target_uri string, refers_to_id string, stored_digest string,"
    " stored_bytes bigint, chunk_no int, data binary, bytes_so_far bigint, digest_so_far string, last boolean"
)


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages``, read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    One row per input row; the digest is base32 SHA-1 of the full payload, for a
    revisit that of the response it refers to. Payloads under ``least`` bytes are
    all responses. Null html is an empty payload; a null ``page_id`` comes back as
    null and counts as smallest; repeated rows with the largest id are all
    responses. Other columns are ignored; an empty table gives no rows. A payload
    that does not match its stored digest ends the query with an error.
    """
    chunks = read_archives(write_archives(pages, least))
    end = chunks.filter("last")
    revisit = F.col("record_type") == "revisit"
    checked = F.when(revisit | (F.col("digest_so_far") == F.col("stored_digest")), F.col("stored_digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("record_id")))
    )
    return end.select(
        _page_of("record_id").alias("page_id"),
        F.when(revisit, F.col("stored_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        checked.alias("payload_digest"),
        "record_type",
        _page_of("refers_to_id").alias("refers_to"),
    )


def write_archives(pages: DataFrame, least: int = 0, date: str | None = None) -> DataFrame:
    """Write gzipped WARC files; the stored manifest ``path, records``."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder = new_folder(pages.sparkSession)
    page = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    planned = page.join(
        _plan(page.select("page_id", "digest", F.octet_length("payload").alias("size")), least),
        page["page_id"].eqNullSafe(F.col("plan_id")) & (F.col("digest") == F.col("plan_digest")),
    ).select("page_id", "url", "digest", "refers_to", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, date)
        for batch in batches:
            for row in zip(*batch.columns):
                writer.add(*row)
        writer.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(writer.paths, pa.string()), pa.array(writer.counts, pa.int64())], ["path", "records"]
        )

    return stored(planned.mapInArrow(run, "path string, records bigint"))


def read_archives(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the WARC files in column ``path``.

    ``record_id, record_type, target_uri, refers_to_id``, ``stored_digest`` and
    ``stored_bytes`` as the record states them, then ``chunk_no`` from 0, ``data``,
    ``bytes_so_far``, ``digest_so_far`` and ``last``. An empty payload is one empty
    chunk. Records of other types are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from _batched(_file_chunks(path, chunk))

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path").repartition(parts, "path").mapInArrow(run, _CHUNKS_SQL)


def _plan(facts: DataFrame, least: int) -> DataFrame:
    """``plan_id, plan_digest, refers_to``: what each page's record refers to, itself if it is a response."""
    facts = durable(facts.distinct())
    best = (
        facts.filter(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("best"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "best")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("best")), F.col("best"))
    return facts.join(best, "digest", "left").select(
        F.col("page_id").alias("plan_id"), F.col("digest").alias("plan_digest"), refers.alias("refers_to")
    )


def _page_of(column: str):
    number = F.regexp_extract(column, f"^<{_URN}(-?[0-9]*):", 1)
    return F.when(number != "", number.cast("bigint"))


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))


class _Writer:
    """Appends records, each a gzip member, to files of about ``FILE_BYTES``."""

    def __init__(self, folder: str, date: str):
        self.folder, self.date = folder, date
        self.paths: list[str] = []
        self.counts: list[int] = []
        self.out = None

    def add(self, page: pa.Scalar, url: pa.Scalar, digest: pa.Scalar, refers_to: pa.Scalar, payload: pa.Scalar):
        data = memoryview(payload.as_buffer())
        page_id, target = page.as_py(), refers_to.as_py()
        sha1 = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
        http = (
            "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(data)}\r\n\r\n"
        ).encode()
        revisit = target is not None
        body = data[:0] if revisit else data
        uri = url.as_py() or f"{_URN}{'' if page_id is None else page_id}"
        lines = [
            "WARC/1.1",
            f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {_record_id(page_id, sha1)}",
            f"WARC-Date: {self.date}",
            f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', uri)}",
            f"WARC-Payload-Digest: sha1:{sha1}",
            "Content-Type: application/http;msgtype=response",
            f"Content-Length: {len(http) + len(body)}",
        ]
        if revisit:
            lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_record_id(target, sha1)}"]
        self._start()
        packer = zlib.compressobj(1, wbits=31)
        self.out.write(packer.compress(("\r\n".join(lines) + "\r\n\r\n").encode() + http))
        for start in range(0, len(body), CHUNK):
            self.out.write(packer.compress(body[start : start + CHUNK]))
        self.out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        self.counts[-1] += 1
        if self.out.tell() >= FILE_BYTES:
            self.close()

    def close(self):
        if self.out is not None:
            self.out.close()
            self.out = None

    def _start(self):
        if self.out is None:
            system, folder = _open(self.folder)
            system.create_dir(folder)
            name = f"{uuid.uuid4().hex}.warc.gz"
            self.out = system.open_output_stream(f"{folder}/{name}", compression=None)
            self.paths.append(f"{self.folder}/{name}")
            self.counts.append(0)


def _record_id(page_id: int | None, sha1: str) -> str:
    return f"<{_URN}{'' if page_id is None else page_id}:{sha1}>"


def _file_chunks(path: str, chunk: int) -> Iterator[dict]:
    system, name = _open(path)
    with system.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw) as archive:
        while line := archive.readline():
            if not line.startswith(b"WARC/"):
                continue  # the blank lines behind a record
            head = _fields(archive)
            size = int(head["content-length"])
            if head["warc-type"] not in ("response", "revisit"):
                _skip(archive, size, chunk)
                continue
            yield from _record_chunks(archive, head, size, chunk)


def _record_chunks(archive, head: dict[str, str], size: int, chunk: int) -> Iterator[dict]:
    used = len(archive.readline())
    http = _fields(archive)
    left = size - used - http.pop("", 0)
    record = {
        "record_id": head["warc-record-id"],
        "record_type": head["warc-type"],
        "target_uri": head.get("warc-target-uri"),
        "refers_to_id": head.get("warc-refers-to"),
        "stored_digest": head["warc-payload-digest"].partition(":")[2],
        "stored_bytes": int(http["content-length"]),
    }
    digest, total, number = hashlib.sha1(), 0, 0
    while True:
        data = archive.read(min(chunk, left))
        if len(data) < min(chunk, left):
            raise EOFError(f"record ends early: {record['record_id']}")
        left -= len(data)
        total += len(data)
        digest.update(data)
        yield record | {
            "chunk_no": number,
            "data": data,
            "bytes_so_far": total,
            "digest_so_far": base64.b32encode(digest.digest()).decode(),
            "last": left == 0,
        }
        number += 1
        if not left:
            return


def _fields(archive) -> dict:
    """Header lines up to the blank one; under "" the bytes they take."""
    fields: dict = {}
    used = 0
    while (line := archive.readline()).strip():
        used += len(line)
        name, _, value = line.decode("utf-8").partition(":")
        fields[name.strip().lower()] = value.strip()
    fields[""] = used + len(line)
    return fields


def _skip(archive, size: int, chunk: int) -> None:
    while size:
        size -= len(archive.read(min(chunk, size))) or size


def _batched(chunks: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in chunks:
        held.append(row)
        size += len(row["data"])
        if size >= 8 * CHUNK or len(held) >= 5000:
            yield pa.RecordBatch.from_pylist(held, schema=_CHUNKS)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_CHUNKS)
