"""Quality rules: plain per-document counts, then line frequency across documents.

Lines are lower-cased, trimmed and hashed. Per host the distinct documents that
hold a line are counted; a line in more than ``LINE_DOCS`` is boilerplate and is
removed, and a document of which too little is left is rejected. The limit is the same
for every host and size of table.

Copies must not make each other's lines look like boilerplate. Documents of equal
normalised lines count once. Near copies do too, by a second count: a document
that has less than a ninth of its words outside the lines that the first count
finds frequent is compared with the fullest such document that has its rarest
frequent line, then with that of its longest, and counts as that one if 80% of
their frequent words are the same. All other documents count each for itself,
however much of them is a licence or a template.

Scale: one pass over the texts writes counts and line hashes, a small table.
All that follows works on hashes. Counts are combined before the shuffle, so a
line in a third of all documents is one row per task. Near copies are compared
with one document each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.durable import durable, stored
from thicket.llm.rows import ROW, with_row_ids

SYMBOLS = "#*$%&|<>"  # fixed values
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of words
LINE_DOCS = 10  # a line in more distinct documents of its host than this is boilerplate
NEAR = 80  # per cent of words that near copies have in common
LEAST_LEFT = 0.3  # share of its words that a document must keep
HOST = ["no_host", "host"]
LINE = [*HOST, "line"]


def line_quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per input row: ``_thicket_row, doc_id``, the counts, ``base_failed, n_removed_words, kept``.

    ``word_chars``: code points in words; ``n_symbols``; ``n_dup_lines``: lines with
    a word equal to an earlier line; ``n_repeat_words``: words in three-word windows
    that occur twice or more. ``base_failed``: under 50 words, or over half of them
    repeated. ``kept``: not ``base_failed`` and at least 30% of the words stand in
    lines that are no boilerplate. Null texts have no words and fail; a null host is
    a host; repeated rows count once as documents and are judged each for itself;
    other columns are ignored; an empty table gives no rows.
    """
    measured = _measured(docs, host)
    return _judged(measured, removed_words(measured, boilerplate_lines(measured)))


def _judged(measured: DataFrame, removed: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    lost = F.coalesce("_lost", F.lit(0))
    return measured.join(removed, ROW, "left").select(
        ROW,
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        lost.alias("n_removed_words"),
        (~failed & (F.col("n_words") - lost >= LEAST_LEFT * F.col("n_words"))).alias("kept"),
    )


def _measured(docs: DataFrame, host: str) -> DataFrame:
    keep = ROW if ROW in docs.columns else F.monotonically_increasing_id().alias(ROW)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(
        docs.select(keep, "doc_id", F.col(host).cast("string").alias("host"), "text").mapInArrow(
            _measure,
            f"{ROW} bigint, doc_id {kind}, host string, n_words bigint, word_chars bigint, n_symbols bigint,"
            " n_dup_lines bigint, n_repeat_words bigint, same bigint,"
            " lines array<struct<line:bigint,words:bigint>>",
        )
    )


def removed_words(measured: DataFrame, bad: DataFrame) -> DataFrame:
    """``_thicket_row, _lost``: words in ``bad`` lines, of documents that have any."""
    lines = _by_host(measured).select(ROW, "no_host", "host", F.inline("lines"))
    hits = lines.join(bad, LINE)
    return hits.groupBy(ROW).agg(F.sum("words").alias("_lost"))


def boilerplate_lines(measured: DataFrame) -> DataFrame:
    """``no_host, host, line`` of the lines in too many distinct documents of their host."""
    documents = _by_host(measured).filter(F.size("lines") > 0)
    single = durable(documents.groupBy(*HOST, "same").agg(F.min(ROW).alias(ROW)).select(*HOST, ROW))
    lines = documents.join(single.select(ROW), ROW, "left_semi").select(ROW, *HOST, "n_words", F.inline("lines"))
    counts = lines.groupBy(*LINE).agg(F.count("*").alias("docs")).filter(F.col("docs") > LINE_DOCS)
    hits = stored(lines.join(durable(counts), LINE))
    units = hits.join(_near_copies(hits), ROW, "left").select(*LINE, F.coalesce("unit", ROW).alias("unit"))
    counts = units.distinct().groupBy(*LINE).agg(F.count("*").alias("docs"))
    return durable(counts.filter(F.col("docs") > LINE_DOCS).select(*LINE))


def _near_copies(hits: DataFrame) -> DataFrame:
    """``_thicket_row, unit``: the row as which a document counts, of those that are nearly all frequent lines.

    With at most ``(100 - NEAR) / (2 * NEAR)`` as many own words as frequent ones, two
    documents of the same frequent lines have ``NEAR`` per cent in common.
    """
    whole = hits.groupBy(ROW, *HOST, "n_words").agg(
        F.sum("words").alias("common"),
        F.collect_list(F.struct("line", "words")).alias("parts"),
        F.min(F.struct("docs", "line")).alias("rarest"),
        F.max(F.struct("words", "line")).alias("longest"),
    )
    copied = whole.filter(2 * NEAR * (F.col("n_words") - F.col("common")) <= (100 - NEAR) * F.col("common"))
    copied = stored(copied.withColumn("rarest", F.col("rarest.line")).withColumn("longest", F.col("longest.line")))
    first = stored(_folded(copied, "rarest"))
    second = _folded(first.filter(F.col("unit") == F.col(ROW)).drop("unit"), "longest")
    last = second.select(F.col(ROW).alias("first"), "unit")
    return first.select(ROW, F.col("unit").alias("first")).join(last, "first").select(ROW, "unit")


def _folded(copied: DataFrame, key: str) -> DataFrame:
    """``copied`` and ``unit``: the row of the fullest document of the same key if near, else its own."""
    fullest = copied.groupBy(*HOST, key).agg(F.max(F.struct("common", F.col(ROW).alias("row"), "parts")).alias("head"))
    both = F.aggregate(
        F.array_intersect("parts", "head.parts"), F.lit(0).cast("bigint"), lambda total, part: total + part["words"]
    )
    near = 100 * F.col("both") >= NEAR * (F.col("common") + F.col("head.common") - F.col("both"))
    pairs = copied.join(fullest, [*HOST, key]).withColumn("both", both)
    return pairs.withColumn("unit", F.when(near, F.col("head.row")).otherwise(F.col(ROW))).select(
        *copied.columns, "unit"
    )


def _by_host(measured: DataFrame) -> DataFrame:
    host = [F.col("host").isNull().alias("no_host"), F.coalesce("host", F.lit("")).alias("host")]
    return measured.select(ROW, *host, "same", "n_words", "lines")


def good_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass ``line_quality``, without their boilerplate lines.

    All columns stay. Null texts fail; repeated rows are judged each for itself; an empty
    table gives no rows.
    """
    keyed = with_row_ids(docs)
    measured = _measured(keyed, host)
    bad = boilerplate_lines(measured)
    kept = _judged(measured, removed_words(measured, bad)).filter("kept").select(ROW)
    return _cut(keyed.join(_bad_lines(measured, bad, kept), ROW), docs.columns)


def without_boilerplate(docs: DataFrame, host: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines cut from their texts; all rows and other columns stay.

    Null texts stay null; a text of nothing else becomes empty.
    """
    keyed = with_row_ids(docs)
    measured = _measured(keyed, host)
    bad = boilerplate_lines(measured)
    return _cut(keyed.join(_bad_lines(measured, bad, measured.select(ROW)), ROW), docs.columns)


def _bad_lines(measured: DataFrame, bad: DataFrame, rows: DataFrame) -> DataFrame:
    """``_thicket_row`` of all ``rows``, and ``_bad``: the keys of its boilerplate lines, null for none."""
    hits = _by_host(measured).select(ROW, *HOST, F.inline("lines")).join(bad, LINE)
    return rows.join(hits.groupBy(ROW).agg(F.collect_list("line").alias("_bad")), ROW, "left")


def _cut(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with the lines whose keys are in ``_bad`` cut from ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, bad in zip(batch.column("text").to_pylist(), batch.column("_bad").to_pylist()):
                texts.append(text if text is None or not bad else cut_lines(text, set(bad)))
            at = columns.index("text")
            arrays = [batch.column(c) for c in columns]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, columns)

    kept = rows.select(*columns, "_bad")
    return kept.mapInArrow(run, kept.drop("_bad").schema)


def cut_lines(text: str, bad: set[int]) -> str:
    def keep(raw: str) -> bool:
        data = raw.encode()
        return not data.strip() or line_key(data) not in bad

    return "\n".join(raw for raw in text.split("\n") if keep(raw))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "same", "lines"]
    line_type = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))
    for batch in batches:
        rows = [counts(value.as_py() or "") for value in batch.column("text")]
        columns = list(zip(*rows)) or [()] * len(names)
        arrays = [pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], line_type)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(ROW), batch.column("doc_id"), batch.column("host"), *arrays],
            [ROW, "doc_id", "host", *names],
        )


def counts(text: str) -> tuple:
    """The measures of one text. Bytes split and strip on ASCII white space only, as words ask."""
    data = text.encode()
    words = data.split()
    spaces = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = [line for line in data.split(b"\n") if line.strip()]
    keys: dict[int, int] = {}
    order = []
    for line in lines:
        size = len(line.split())
        key = line_key(line)
        keys[key] = keys.get(key, 0) + size
        order.append(key)
    return (
        len(words),
        len(text) - spaces,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        _number(b"".join(key.to_bytes(8, "big", signed=True) for key in order)),
        [{"line": key, "words": size} for key, size in keys.items()],
    )


def line_key(line: bytes) -> int:
    return _number(line.strip().decode().lower().encode())


def _number(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three that occurs twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for window in windows:
        (twice if window in seen else seen).add(window)
    total, upto = 0, 0
    for at, window in enumerate(windows):
        if window in twice:
            total += at + WINDOW - max(at, upto)
            upto = at + WINDOW
    return total
