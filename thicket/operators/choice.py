"""Which of the titles in a text become links."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from thicket.functions.grams import TitleFilter, TitleNames, TitleOrder, slabs
from thicket.operators.mentions import BLOCK_UNITS, in_runs, searched
from thicket.operators.targets import Dictionary

EDITS = "array<struct<start:int,end:int,target:string>>"
# Entries of titles that are sorted at once, of one note at least: this bounds the arrays.
SLAB = 1 << 20


def chosen_texts(dictionary: Dictionary, order: TitleOrder, cap: int) -> Callable[..., Column]:
    """A function of text, spans to keep and hashes of names to pass over: (start, key, number) of each
    link, in text order. ``number`` counts in the entries of the title ``key``.

    A text counts as a title here if it shares the 64 bits of its hash; whoever joins the
    links with the titles compares the texts themselves.
    """
    context = dictionary.titles.sparkSession.sparkContext
    tables = context.broadcast((dictionary.title_filter(whole=True), order))
    block, slab = BLOCK_UNITS, SLAB

    @F.arrow_udf("array<struct<start:int,key:string,number:int>>")
    def chosen(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known, order = tables.value
        for texts, kept, names in in_runs(batches, block):
            yield _chosen(texts, kept, names, known, order, cap, block, slab)

    return chosen


def edited_texts(
    dictionary: Dictionary,
    tables: tuple[TitleOrder, TitleNames],
    cap: int,
    kind: DataType | str = EDITS,
    made: Callable[[pa.Array, pa.Array], pa.Array] | None = None,
) -> Callable[..., Column]:
    """A function of what ``chosen_texts`` takes: the links of each text with the names of their targets, or what
    ``made`` makes of the texts and these links.

    Texts are compared with the titles themselves.
    """
    context = dictionary.titles.sparkSession.sparkContext
    held = context.broadcast((dictionary.title_filter(whole=True), *tables))
    block, slab = BLOCK_UNITS, SLAB

    @F.arrow_udf(kind)
    def described(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known, order, titles = held.value
        for texts, kept, names in in_runs(batches, block):
            edits = _edited(texts, kept, names, known, order, titles, cap, block, slab)
            yield made(texts, edits) if made else edits

    return described


def greedy(
    places: Callable[[int], tuple[int, Iterable[int]]],
    ordered: Iterable[tuple[object, object, int]],
    size: int,
    kept: Iterable[tuple[int, int]],
    done: set,
    cap: int,
) -> list[tuple[int, int, object]]:
    """(start, width, tag) of the links of one note, in text order.

    ``ordered`` are (target, tag, title), the ones to be taken first in front; ``places`` gives
    width and starts of a title. ``done`` is changed.
    """
    taken, opened, edits = bytearray(size), {}, []
    for start, end in kept:
        end = min(end, size)
        if start < end:
            taken[start:end] = b"\1" * (end - start)
    for target, tag, i in ordered:
        if target in done:
            continue
        if i not in opened:
            width, starts = places(i)
            opened[i] = width, _apart(starts, width)
        width, next_places = opened[i]
        for start in next_places:
            if taken.find(1, start, start + width) < 0:
                taken[start : start + width] = b"\1" * width
                done.add(target)
                edits.append((start, width, tag))
                break
        if cap and len(edits) == cap:
            break
    return sorted(edits, key=lambda e: e[0])


def _apart(starts: Iterable[int], width: int) -> Iterator[int]:
    end = 0
    for start in starts:
        if start >= end:
            end = start + width
            yield start


def _chosen(
    texts: pa.Array, kept: pa.Array, names: pa.Array, known: TitleFilter, order: TitleOrder, cap: int, block: int, slab: int
) -> pa.Array:
    counts, starts, keys, numbers = np.zeros(len(texts) + 1, np.int64), [], [], []
    for n, at, key, entry in _taken(texts, kept, names, known, order, None, cap, block, slab):
        counts[n + 1] += 1
        starts.append(at)
        keys.append(key)
        numbers.append(order.numbers[entry])
    return _listed(
        counts, start=pa.array(starts, pa.int32()), key=pa.array(keys, pa.string()), number=pa.array(numbers, pa.int32())
    )


def _edited(
    texts: pa.Array,
    kept: pa.Array,
    names: pa.Array,
    known: TitleFilter,
    order: TitleOrder,
    titles: TitleNames,
    cap: int,
    block: int,
    slab: int,
) -> pa.Array:
    counts, starts, ends, entries = np.zeros(len(texts) + 1, np.int64), [], [], []
    for n, at, key, entry in _taken(texts, kept, names, known, order, titles, cap, block, slab):
        counts[n + 1] += 1
        starts.append(at)
        ends.append(at + len(key))
        entries.append(entry)
    targets = titles.targets.take(pa.array(entries, pa.int32()))
    return _listed(counts, start=pa.array(starts, pa.int32()), end=pa.array(ends, pa.int32()), target=targets)


def _listed(counts: np.ndarray, **columns: pa.Array) -> pa.Array:
    links = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), links)


def _taken(
    texts: pa.Array,
    kept: pa.Array,
    names: pa.Array,
    known: TitleFilter,
    order: TitleOrder,
    titles: TitleNames | None,
    cap: int,
    block: int,
    slab: int,
) -> Iterator[tuple[int, int, str, int]]:
    """(text, start, key, entry) of each link, in order. With ``titles``, a stretch that only shares a title's hash is
    passed over."""
    groups, joined = [], []
    for row, place, start, end, hashed, text in searched(texts, block, known):
        title, is_title = order.find(hashed)
        held = (row, title, place, start, end, np.full(len(row), len(joined)))
        groups.append([column[is_title] for column in held])
        joined.append(text)
    # By note and title, places in order.
    columns = [np.concatenate(c) for c in zip(*groups, strict=True)] or [np.zeros(0, np.int64)] * 6
    by_title = np.lexsort((columns[2], columns[1], columns[0]))
    row, title, place, start, end, part = (column[by_title] for column in columns)
    changes = np.flatnonzero((row[1:] != row[:-1]) | (title[1:] != title[:-1])) + 1
    first = np.concatenate(([0], changes)).astype(np.int64)[: len(row)]
    last = np.append(first[1:], len(row))
    widths = end - start
    spans, span_offsets = [kept.values.field(c).to_numpy() for c in ("start", "end")], kept.offsets.to_numpy()
    hashes, name_offsets = names.values.to_numpy(), names.offsets.to_numpy()
    for n, found, entry, target in _in_order(row[first], title[first], order, len(texts), slab):

        # One conversion a note: those by title cost more than the choice.
        least, most = int(found.min()), int(found.max())
        own = slice(first[least], last[most])
        bounds = (np.append(first[least : most + 1], last[most]) - first[least]).tolist()
        spots, cuts = place[own].tolist(), (part[own].tolist(), start[own].tolist(), end[own].tolist())

        def places(i: int) -> tuple[int, list[int]]:
            a, b = bounds[i - least], bounds[i - least + 1]
            width = cuts[2][a] - cuts[1][a]
            if titles is None:
                return width, spots[a:b]
            number = title[first[i]]
            key = titles.key(number, order.offsets[number])
            return width, [spots[k] for k in range(a, b) if joined[cuts[0][k]][cuts[1][k] : cuts[2][k]] == key]

        size = int((place[own] + widths[own]).max())
        barred = slice(span_offsets[n], span_offsets[n + 1])
        taken = greedy(
            places,
            zip(target.tolist(), zip(entry.tolist(), found.tolist(), strict=True), found.tolist(), strict=True),
            size,
            zip(spans[0][barred].tolist(), spans[1][barred].tolist(), strict=True),
            set(hashes[name_offsets[n] : name_offsets[n + 1]].tolist()),
            cap,
        )
        for at, _, (e, i) in taken:
            k = bounds[i - least]
            yield n, at, joined[cuts[0][k]][cuts[1][k] : cuts[2][k]], e


def _in_order(
    row: np.ndarray, title: np.ndarray, order: TitleOrder, rows: int, slab: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By note (row, found, entry, target) of what its titles can stand for, the ones to be taken first in front.
    ``row`` ascends; ``found`` counts in it."""
    entries = (order.offsets[title + 1] - order.offsets[title]).astype(np.int64)
    before = np.concatenate(([0], np.cumsum(entries)))
    of_row = np.searchsorted(row, np.arange(rows + 1))
    for n, stop in slabs(before[of_row], slab):
        a, b = of_row[n], of_row[stop]
        found = np.repeat(np.arange(a, b), entries[a:b])
        entry = np.arange(before[a], before[b]) - before[found] + order.offsets[title[found]]
        ranked = np.lexsort((order.ranks[entry], row[found]))
        found, entry = found[ranked], entry[ranked]
        bounds = (before[of_row[n : stop + 1]] - before[a]).tolist()
        for k in range(stop - n):
            if bounds[k] < bounds[k + 1]:
                own = slice(bounds[k], bounds[k + 1])
                yield n + k, found[own], entry[own], order.targets[entry[own]]
