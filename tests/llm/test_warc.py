from __future__ import annotations

import base64
import gzip
import hashlib
from collections import defaultdict

import pytest

from thicket.llm import warc

SCHEMA = "page_id bigint, url string, html string, path string, record_type string, digest string"
PAGES = [
    (1, "http://a/ b\n", "<p>same</p>"),
    (2, None, "<p>same</p>"),
    (3, "http://c", None),
    (4, "http://d", ""),
    (5, "http://e", "ä\r\n\r\nWARC/1.1\r\n" * 5000),
    (6, "http://f", "x" * 3_000_000),
    (9, "http://g", "x" * 3_000_000),
    (7, "http://h", "only"),
    (7, "http://h", "only"),
    (None, "http://i", "<p>same</p>"),
    (None, "http://j", "no id"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "x", "y", "z") for p in PAGES], SCHEMA).repartition(3)


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(least=0):
    best = defaultdict(lambda: None)
    for page_id, _, html in PAGES:
        if page_id is not None:
            best[sha1(html)] = max(page_id, best[sha1(html)] or page_id)
    out = []
    for page_id, _, html in PAGES:
        size, digest = len((html or "").encode()), sha1(html)
        first = best[digest]
        revisit = size >= least and first != page_id
        out.append((page_id, size, digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(pages, least):
    assert sorted(map(tuple, warc.archive_round_trip(pages, least).collect()), key=str) == expected(least)


def test_chunks(pages):
    """Small chunks join to the payload, with a digest of every beginning."""
    chunks = warc.read_archives(warc.write_archives(pages), chunk=50_000).collect()
    records = defaultdict(list)
    for row in chunks:
        if row["record_type"] == "response":
            records[row["record_id"]].append(row)
    payloads = {sha1(html): (html or "").encode() for _, _, html in PAGES}
    long = 0
    for rows in records.values():
        rows = sorted(rows, key=lambda r: r["chunk_no"])
        if "urn:thicket:page:7:" in rows[0]["record_id"]:
            continue  # a repeated row gives two records of one name
        data = b"".join(r["data"] for r in rows)
        assert data == payloads[rows[0]["stored_digest"]] and [r["last"] for r in rows].count(True) == 1
        at = b""
        for r in rows:
            at += r["data"]
            assert r["bytes_so_far"] == len(at) and len(r["data"]) <= 50_000
            assert r["digest_so_far"] == base64.b32encode(hashlib.sha1(at).digest()).decode()
        long += len(rows) > 10
    assert long == 1


def test_files_are_warc(spark, pages):
    for row in warc.write_archives(pages).collect():
        with gzip.open(row["path"].removeprefix("file:")) as lines:
            data = lines.read()
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: re") and data.endswith(b"\r\n\r\n")
        assert row["records"] >= 1


def test_no_pages(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
