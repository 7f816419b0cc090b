"""Repeated substrings by sorting suffixes: every byte that a repeat of 100 bytes covers.

A window is a string of ``LENGTH`` bytes inside one document. A byte goes if a
window over it also starts earlier. Only suffixes that can matter are sorted:

1. Every window is named by its anchor, the smallest hash among its strings of
   ``GRAM`` bytes. Equal windows have equal anchors at equal distances. Windows of
   one anchor form a cell. All windows of a cell share a core; if the core occurs
   nowhere else, none of them repeats, and the cell is dropped. Cells that are
   equal as a whole are one class: all but the earliest are removed.
2. Of classes that share a core but differ, the cells are cut into smaller ones
   of ``FINE`` windows, and the same is done again. This leaves the windows next to
   the ends of repeats.
3. Those suffixes are sorted by distributed merge sort. A task sorts runs and
   front-codes them: of each suffix it sends only what differs from the one before.
   Runs are exchanged by ranges and merged by a loser tree that knows how many
   bytes each head shares with the last winner, and compares only what follows.
   Neighbours that share ``LENGTH`` bytes are equal; the earliest stays.

Step 1 and 2 compare 64-bit fingerprints of cores and cells; a full sort of all
suffixes would move a hundred times the input. A task collapses its own equal
cells first, so a passage in any share of the documents is one row per task and
class, and cells of one core with different surroundings are dealt by class.

Texts are dealt once, to a bucketed table, and never shuffled again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.durable import durable, new_folder, stored
from thicket.llm.suffix_merge import repeated_windows

LENGTH = 100
GRAM = 32
FINE = 8
_REACH = LENGTH - GRAM + 1  # windows that one anchor can name
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_U64 = np.uint64
_CELL, _TOKEN, _SPAN = 0, 1, 2
_CELLS = "kind int, part bigint, core bigint, full bigint, doc bigint, row bigint, anchor int, p1 int, p2 int"
_OPEN = "array<struct<anchor:int,p1:int,p2:int>>"
_LAST = np.iinfo(np.int64).max


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Texts are UTF-8 bytes, null as empty; windows never cross documents. Earlier is
    the smaller ``doc_id`` (null last, then the row), then the smaller start. Of
    repeated rows the first keeps its bytes. Other columns are ignored; an empty
    table gives no rows.
    """
    texts = _bucketed(docs)
    spans = repeat_spans(texts)
    joined = texts.join(spans.groupBy("row").agg(F.collect_list(F.struct("p1", "p2")).alias("spans")), "row", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "spans").mapInArrow(
        _digests, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )


def repeat_spans(texts: DataFrame) -> DataFrame:
    """``row, p1, p2``: runs of window starts that repeat. ``texts``: ``row, doc, text``."""
    coarse, open_ = _level(texts, None, _REACH)
    fine, open_ = _level(texts, open_, FINE)
    last = repeated_windows(texts.join(_by_row(open_), "row"), LENGTH)
    return coarse.unionByName(fine).unionByName(last)


def _bucketed(docs: DataFrame) -> DataFrame:
    """Texts in a table that is bucketed by row, so that later joins move only the other side."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    keyed = keyed.withColumn("doc", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)))
    folder = new_folder(spark)
    name = f"repeats_{folder.rsplit('/', 1)[1]}"
    (
        keyed.repartition(parts, "row")
        .write.format("parquet")
        .option("compression", "zstd")
        .option("path", folder)
        .bucketBy(parts, "row")
        .saveAsTable(name)
    )
    return spark.table(name)


def _by_row(cells: DataFrame) -> DataFrame:
    return cells.groupBy("row").agg(F.collect_list(F.struct("anchor", "p1", "p2")).alias("open"))


def _level(texts: DataFrame, open_: DataFrame | None, width: int) -> tuple[DataFrame, DataFrame]:
    """Spans that repeat as whole cells of ``width`` windows, and the cells that may repeat in part."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if open_ is None:
        source = texts.select("row", "doc", "text", F.lit(None).cast(_OPEN).alias("open"))
    else:
        source = texts.join(_by_row(open_), "row").select("row", "doc", "text", "open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cells(batches, width)

    found = stored(
        source.mapInArrow(run, _CELLS)
        .repartition(parts, "part")
        .sortWithinPartitions("part")
        .mapInArrow(_in_company, _CELLS)
    )
    cells = found.filter(F.col("kind") == _CELL)
    first = F.min(F.struct("doc", "row", "p1", "p2", "anchor")).alias("first")
    classes = durable(cells.groupBy("core", "full").agg(first).select("core", "first.*"))
    repeats = cells.join(classes.select("row", "p1"), ["row", "p1"], "left_anti")
    spans = found.filter(F.col("kind") == _SPAN).select("row", "p1", "p2").union(repeats.select("row", "p1", "p2"))
    differ = classes.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core")
    return spans, durable(classes.join(differ, "core").select("row", "anchor", "p1", "p2"))


def _cells(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The cells of the documents, equal ones within a batch collapsed."""
    for batch in batches:
        found = [_chunk_cells(part, width) for part in _portions(batch)]
        found = [f for f in found if len(f["row"])]
        if found:
            yield _collapsed({k: np.concatenate([f[k] for f in found]) for k in found[0]})


def _chunk_cells(part: list[tuple[int, int, bytes, list | None]], width: int) -> dict[str, np.ndarray]:
    """Cells of some documents: hashes of core and whole, and where they are."""
    data = np.frombuffer(b"".join(p[2] for p in part), np.uint8)
    lengths = np.array([len(p[2]) for p in part], np.int64)
    offsets = np.cumsum(lengths) - lengths
    sums, inverse = _sums(data)

    def hashed(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((sums[end] - sums[start]) * inverse[start])

    if part[0][3] is None:
        anchors, p1, p2 = _anchored(data, offsets, lengths, hashed)
    else:
        blocks = [
            (o + b["anchor"], o + b["p1"], o + b["p2"]) for o, p in zip(offsets.tolist(), part) for b in p[3]
        ]
        anchors, p1, p2 = np.array(blocks, np.int64).reshape(-1, 3).T
    if width < _REACH:
        anchors, p1, p2 = _cut(anchors, p1, p2, width)
    # Cells lie on a grid of distances between a window and its anchor.
    grid = (anchors - p2) // width * width
    reach = np.minimum(grid + width - 1, _REACH - 1)
    core = hashed(anchors - grid, anchors - reach + LENGTH)
    core = _mixed(core + grid.astype(np.uint64))
    full = hashed(p1, p2 + LENGTH) ^ _mixed(((anchors - p1) * 128 + (anchors - p2)).astype(np.uint64))
    of = np.searchsorted(offsets, p1, side="right") - 1
    rows, docs = np.array([p[0] for p in part]), np.array([p[1] for p in part])
    at = offsets[of]
    return {
        "core": core.view(np.int64), "full": full.view(np.int64), "doc": docs[of], "row": rows[of],
        "anchor": anchors - at, "p1": p1 - at, "p2": p2 - at,
    }


def _anchored(data, offsets, lengths, hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window of each run of windows with one anchor."""
    windows = len(data) - LENGTH + 1
    if windows <= 0:
        return np.empty((3, 0), np.int64)
    at = np.arange(len(data) - GRAM + 1)
    low = (hashed(at, at + GRAM) >> _U64(32)) << _U64(32) | at.astype(np.uint64)
    span = 1
    while span * 2 <= _REACH:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: windows], low[_REACH - span :][:windows])
    anchor = (low & _U64(0xFFFFFFFF)).astype(np.int64)
    ends = np.zeros(len(data) + 1, np.int32)  # windows that would cross into the next document
    for offset, length in zip(offsets.tolist(), lengths.tolist()):
        ends[max(offset, offset + length - LENGTH + 1)] += 1
        ends[offset + length] -= 1
    inside = np.flatnonzero(np.cumsum(ends)[:windows] == 0)
    if not len(inside):
        return np.empty((3, 0), np.int64)
    anchor = anchor[inside]
    cuts = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(inside) != 1)) + 1
    starts, stops = np.append(0, cuts), np.append(cuts, len(inside)) - 1
    return anchor[starts], inside[starts], inside[stops]


def _cut(anchors, p1, p2, width) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut cells at multiples of ``width`` in the distance from the anchor."""
    low, high = (anchors - p2) // width, (anchors - p1) // width
    pieces = high - low + 1
    of = np.repeat(np.arange(len(anchors)), pieces)
    step = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    anchors, grid = anchors[of], (low[of] + step) * width
    return anchors, np.maximum(p1[of], anchors - grid - width + 1), np.minimum(p2[of], anchors - grid)


def _collapsed(c: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Of equal cells the earliest; the others are spans. Cores seen twice go by class."""
    order = np.lexsort((c["p1"], c["row"], c["doc"], c["full"], c["core"]))
    c = {k: v[order] for k, v in c.items()}
    same_core = np.append(False, np.diff(c["core"]) == 0)
    again = same_core & np.append(False, np.diff(c["full"]) == 0)
    first = ~again
    kept = np.flatnonzero(first)
    # Among the classes that are left: does the core have another one here?
    core = c["core"][kept]
    near = np.diff(core) == 0
    many = np.append(False, near) | np.append(near, False)
    mixed = _mixed(core.view(np.uint64) ^ (c["full"][kept].view(np.uint64) * _U64(_BASE))).view(np.int64)
    part = c["row"].copy()
    part[kept] = np.where(many, mixed, core)
    kind = np.where(again, _SPAN, _CELL)
    tokens = np.flatnonzero(many & ~np.append(False, near))  # one for each such core
    columns = {"kind": np.append(kind, np.full(len(tokens), _TOKEN)), "part": np.append(part, core[tokens])}
    for name in ("core", "full", "doc", "row", "anchor", "p1", "p2"):
        columns[name] = np.append(c[name], c[name][kept][tokens])
    # Most cells are alone with their core, which then is their part; and a span is
    # only a place. Zeros cost nothing in the shuffle.
    plain = columns["kind"] == _SPAN
    columns["core"] = np.where(plain | (columns["part"] == columns["core"]), 0, columns["core"])
    for name in ("full", "doc"):
        columns[name] = np.where(plain, 0, columns[name])
    small = {"kind", "anchor", "p1", "p2"}
    arrays = [pa.array(v, pa.int32() if k in small else pa.int64()) for k, v in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _in_company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans, cells dealt by class, and cells whose core has more than one row. Sorted by ``part``."""
    held: pa.RecordBatch | None = None  # the last row, until the next one is known
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        part, core = batch.column("part").to_numpy(), batch.column("core").to_numpy()
        kind = batch.column("kind").to_numpy()
        single = (kind != _SPAN) & (core == 0)
        equal = np.diff(part) == 0
        company = np.append(before is not None and before == part[0], equal) | np.append(equal, False)
        keep = (kind != _TOKEN) & (~single | company)
        end = batch.num_rows - 1
        yield _with_core(batch.slice(0, end).filter(pa.array(keep[:end])))
        before = part[end - 1] if end else before
        held = batch.slice(end)
    if held is not None:
        kind, part = held.column("kind")[0].as_py(), held.column("part")[0].as_py()
        alone = held.column("core")[0].as_py() == 0 and kind != _SPAN and before != part
        yield _with_core(held.slice(0, 0 if alone or kind == _TOKEN else 1))


def _with_core(batch: pa.RecordBatch) -> pa.RecordBatch:
    core, part = batch.column("core").to_numpy(), batch.column("part").to_numpy()
    return batch.set_column(batch.schema.get_field_index("core"), "core", pa.array(np.where(core == 0, part, core)))


def _portions(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, bytes, list | None]]]:
    part, size = [], 0
    columns = [batch.column(name) for name in ("row", "doc", "text", "open")]
    for row, doc, text, blocks in zip(*columns):
        data = (text.as_py() or "").encode()
        part.append((row.as_py(), doc.as_py(), data, blocks.as_py()))
        size += len(data)
        if size >= _CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        out: list[tuple] = []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            data = (text.as_py() or "").encode()
            digest, upto, removed, runs = hashlib.sha256(), 0, 0, 0
            for start, end in removed_ranges(spans.as_py() or []):
                digest.update(data[upto:start])
                removed, runs, upto = removed + end - start, runs + 1, end
            digest.update(data[upto:])
            out.append((len(data), removed, runs, digest.hexdigest()))
        columns = list(zip(*out)) or [()] * 4
        arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])


def removed_ranges(spans: list[dict]) -> list[tuple[int, int]]:
    """Byte ranges that the windows of ``spans`` cover, joined where they touch."""
    out: list[tuple[int, int]] = []
    for p1, p2 in sorted((s["p1"], s["p2"]) for s in spans):
        if out and p1 <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], p2 + LENGTH))
        else:
            out.append((p1, p2 + LENGTH))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_POWERS: list[np.ndarray] = []


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a polynomial in the bytes, and powers of the inverse of its base."""
    size = len(data) + 1
    if not _POWERS or len(_POWERS[0]) < size:
        bases = (_BASE, pow(_BASE, -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.append(_U64(1), np.full(size, b, np.uint64)), dtype=np.uint64) for b in bases]
    sums = np.zeros(size, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U64(1)) * _POWERS[0][: size - 1], out=sums[1:])
    return sums, _POWERS[1]
