"""Sort suffixes across tasks: front-coded runs, exchanged by range, merged by a loser tree."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 50_000  # suffixes of one sorted run
SAMPLE = 20_000  # suffixes, about, from which the ranges are cut
_RUNS = "target int, shared binary, tails binary, lengths binary, doc binary, row binary, start binary"


def repeated_windows(open_texts: DataFrame, length: int) -> DataFrame:
    """``row, p1, p2``: windows that equal an earlier one. ``open_texts``: ``row, doc, text, open``.

    Only the windows that ``open`` names are compared, with each other. Ranges are
    cut at suffixes of a bounded sample, so equal suffixes meet in one range.
    """
    spark = open_texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(open_texts, length, parts)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int, int]] = []
        for batch in batches:
            for window in _windows(batch, length):
                held.append(window)
                if len(held) == RUN:
                    yield _encoded(held, cuts)
                    held = []
        if held:
            yield _encoded(held, cuts)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_range: dict[int, list[Iterator]] = {}
        for batch in batches:
            for run in batch.to_pylist():
                by_range.setdefault(run["target"], []).append(_decoded(run))
        for target in sorted(by_range):
            yield from _repeats(merge(by_range.pop(target)), length)

    return (
        open_texts.select("row", "doc", "text", "open")
        .mapInArrow(runs, _RUNS)
        .repartition(parts, "target")
        .mapInArrow(merged, "row bigint, p1 int, p2 int")
    )


def _cuts(open_texts: DataFrame, length: int, parts: int) -> list[bytes]:
    """Up to ``parts`` - 1 suffixes that cut a sample evenly, one suffix of each sampled text."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, blocks in zip(batch.column("text"), batch.column("open")):
                start = blocks[0]["p1"].as_py()
                out.append(text.as_py().encode()[start : start + length])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["suffix"])

    every = -(-open_texts.count() // SAMPLE)
    chosen = open_texts.filter(F.pmod(F.xxhash64("row"), F.lit(max(1, every))) == 0).select("text", "open")
    sample = sorted(r[0] for r in chosen.mapInArrow(first, "suffix binary").collect())
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def _windows(batch: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, int, int, int]]:
    for row, doc, text, blocks in zip(*(batch.column(c) for c in ("row", "doc", "text", "open"))):
        data = text.as_py().encode()
        for block in blocks.as_py():
            for start in range(block["p1"], block["p2"] + 1):
                yield data[start : start + length], doc.as_py(), row.as_py(), start


def _encoded(run: list[tuple[bytes, int, int, int]], cuts: list[bytes]) -> pa.RecordBatch:
    """A sorted run in one row per range, each suffix without what it shares with the one before."""
    run.sort()
    pieces: dict[int, list] = {}
    for window in run:
        pieces.setdefault(bisect_right(cuts, window[0]), []).append(window)
    rows = []
    for target, piece in pieces.items():
        shared, tails, before = bytearray(), [], b""
        for suffix, *_ in piece:
            same = common(before, suffix, 0)
            shared.append(min(same, 255))
            tails.append(suffix[min(same, 255) :])
            before = suffix
        numbers = np.array([w[1:] for w in piece], np.int64).T
        rows.append(
            {
                "target": target,
                "shared": bytes(shared),
                "tails": b"".join(tails),
                "lengths": np.array([len(t) for t in tails], np.int32).tobytes(),
                "doc": numbers[0].tobytes(),
                "row": numbers[1].tobytes(),
                "start": numbers[2].tobytes(),
            }
        )
    schema = pa.schema([("target", pa.int32())] + [(n, pa.binary()) for n in list(rows[0])[1:]])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _decoded(run: dict) -> Iterator[tuple[int, bytes, tuple[int, int, int]]]:
    """Bytes shared with the suffix before in the run, the suffix, and whose it is."""
    places = zip(*(np.frombuffer(run[n], np.int64).tolist() for n in ("doc", "row", "start")))
    lengths = np.frombuffer(run["lengths"], np.int32).tolist()
    before, at, tails = b"", 0, run["tails"]
    for same, size, place in zip(run["shared"], lengths, places):
        before = before[:same] + tails[at : at + size]
        at += size
        yield same, before, place


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    end = min(len(a), len(b))
    if a[known:end] == b[known:end]:
        return end
    while a[known] == b[known]:
        known += 1
    return known


def merge(runs: list[Iterator]) -> Iterator[tuple[int, bytes, tuple[int, int, int]]]:
    """All suffixes of sorted runs in order, each with what it shares with the one before.

    A loser tree. Every head carries the length it shares with the last winner. Of
    two heads the one that shares more is smaller, without a look at their bytes;
    at equal lengths they are compared from there on, and the loser keeps the
    length it shares with the one that beat it.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list = [next(run, None) for run in runs] + [None] * (size - len(runs))
    shared = [0] * size
    losers = [-1] * size

    def beats(a: int, b: int) -> bool:
        """Whether head ``a`` comes before head ``b``; sets the loser's shared length."""
        if heads[b] is None:
            return True
        if heads[a] is None:
            return False
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        x, y = heads[a][1], heads[b][1]
        same = common(x, y, shared[a])
        if same == len(x) or (same < len(y) and x[same] < y[same]):
            shared[b] = same
            return True
        shared[a] = same
        return False

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        above = []
        for i in range(level):
            a, b = winners[2 * i], winners[2 * i + 1]
            win, lose = (a, b) if beats(a, b) else (b, a)
            losers[level + i] = lose
            above.append(win)
        winners = above
    winner = winners[0]
    while heads[winner] is not None:
        _, suffix, place = heads[winner]
        yield shared[winner], suffix, place
        heads[winner] = next(runs[winner], None)
        if heads[winner] is not None:
            shared[winner] = heads[winner][0]
        node = (size + winner) // 2
        while node:
            if not beats(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


def _repeats(ordered: Iterator[tuple[int, bytes, tuple[int, int, int]]], length: int) -> Iterator[pa.RecordBatch]:
    """Of equal suffixes all but the earliest."""
    rows, starts = [], []
    first: tuple[int, int, int] | None = None
    for same, suffix, place in ordered:
        if first is None or same < length:
            first = place
            continue
        first, later = min(first, place), max(first, place)
        rows.append(later[1])
        starts.append(later[2])
        if len(rows) == RUN:
            yield _batch(rows, starts)
            rows, starts = [], []
    yield _batch(rows, starts)


def _batch(rows: list[int], starts: list[int]) -> pa.RecordBatch:
    at = pa.array(starts, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), at, at], ["row", "p1", "p2"])
