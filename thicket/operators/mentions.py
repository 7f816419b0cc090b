"""Where notes mention the titles of other notes.

The naive form is a join of every note with every title on "text contains
title". Here both sides are cut into units and joined on equal text instead:

1. a text is cut into units; long ones into blocks of bounded size first,
2. each unit looks up, by a hash of the units a title starts with, which title
   sizes can start there at all, and a Bloom filter of whole titles lets few texts
   through that are none; both are small tables that every task has,
3. only those texts are joined with the titles, on equality.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.config import Config
from thicket.functions.grams import TitleFilter, slabs
from thicket.functions.once import computed
from thicket.operators.targets import Dictionary

# Characters searched at once, of short notes or of a part of a long one: this bounds the arrays.
BLOCK_UNITS = 1 << 17
_FOUND = "struct<starts:array<int>,keys:array<string>>"


def find_mentions(notes: DataFrame, dictionary: Dictionary, cfg: Config) -> DataFrame:
    """(path, key, id, start): every mention, free or not.

    ``notes`` has (path, content). The keys of a dictionary below the broadcast limit
    are joined where the text lies. For a larger one the texts that can be a title, 30
    bytes or so each, are shuffled by title; a title that is mentioned everywhere is
    one row on its side, which AQE's skew join can replicate.
    """
    return _matched(_title_texts(notes, dictionary), dictionary)


def titles_in_notes(notes: DataFrame, dictionary: Dictionary, cfg: Config) -> DataFrame:
    """(path, match_len, width, entries, starts): the titles each note mentions, and where."""
    return titles_among(_title_texts(notes, dictionary), dictionary)


def titles_among(texts: DataFrame, dictionary: Dictionary) -> DataFrame:
    """(path, match_len, width, entries, starts): the titles among (path, start, key).

    ``texts`` lie partitioned by path. Mentions are grouped there, as ids and places; what a
    title stands for is joined once a note and title. Above the broadcast limit the texts
    that can be a title are grouped before they are shuffled.
    """
    starts = F.sort_array(F.collect_list("start")).alias("starts")
    if dictionary.is_small:
        grouped = _matched(texts, dictionary).groupBy("path", "id").agg(starts)
        found = grouped.join(F.broadcast(dictionary.titles.select("id", "width", "match_len", "entries")), "id")
    else:
        grouped = texts.groupBy("path", "key").agg(starts)
        found = grouped.join(dictionary.titles.select("key", "width", "match_len", "entries"), "key")
    return found.select("path", "match_len", "width", "entries", "starts")


def title_sized_texts(notes: DataFrame, dictionary: Dictionary, cfg: Config) -> DataFrame:
    """(path, start, key): texts with the beginning and the size of some title.

    Where those would be shuffled, they also pass a filter of whole titles first.
    """
    return _title_texts(notes, dictionary, whole=not dictionary.is_small)


def exploded(found: Column) -> Column:
    """Rows (start, key) of ``found_texts``."""
    return F.inline(F.arrays_zip(found["starts"].alias("start"), found["keys"].alias("key")))


def found_texts(content: Column, dictionary: Dictionary, whole: bool = True) -> Column:
    """Texts of ``content`` that pass the filter of titles' beginnings, and with ``whole`` that of
    whole titles, in order: places, and the texts as titles are written."""
    known = dictionary.titles.sparkSession.sparkContext.broadcast(dictionary.title_filter(whole))
    block = BLOCK_UNITS

    @F.arrow_udf(_FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (texts,) in in_runs(zip(batches), block):
            yield _found(texts, block, known.value)

    return found(F.make_valid_utf8(content))


def _matched(texts: DataFrame, dictionary: Dictionary) -> DataFrame:
    keys = dictionary.titles.select("key", "id")
    return texts.join(F.broadcast(keys) if dictionary.is_small else keys, "key")


def _title_texts(notes: DataFrame, dictionary: Dictionary, whole: bool = True) -> DataFrame:
    # Spark cannot run a helper on a text that is itself made with lambdas, so that is made first.
    given = notes.select("path", computed(content=F.col("content")))
    found = given.select("path", found_texts(F.col("content"), dictionary, whole).alias("found"))
    return found.select("path", computed(found=F.col("found"))).select("path", exploded(F.col("found")))


def in_runs(batches: Iterable[tuple[pa.Array, ...]], block: int) -> Iterator[list[pa.Array]]:
    """Batches of columns, the first one of texts, in runs of at most ``block`` characters or one text: what a batch
    mentions may be far larger than the batch, so it is never held at once."""
    for columns in batches:
        lengths = pc.fill_null(pc.utf8_length(columns[0]), 0).to_numpy(zero_copy_only=False)
        for a, b in slabs(np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))), block):
            yield [column.slice(a, b - a) for column in columns]


def _found(texts: pa.Array, block: int, known: TitleFilter) -> pa.Array:
    """By text the places and the texts found there."""
    counts = np.zeros(len(texts) + 1, np.int64)
    places, keys = [np.zeros(0, np.int64)], [pa.array([], pa.string())]
    for row, place, start, end, _, joined in searched(texts, block, known):
        keys.append(pa.array([joined[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)], pa.string()))
        places.append(place)
        np.add.at(counts, row + 1, 1)
    offsets = pa.array(np.cumsum(counts), pa.int32())
    starts = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(places), pa.int32()))
    return pa.StructArray.from_arrays(
        [starts, pa.ListArray.from_arrays(offsets, pa.concat_arrays(keys))], ["starts", "keys"]
    )


def searched(
    texts: pa.Array, block: int, known: TitleFilter
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]]:
    """(row, place, start, end, hash) of what is found, and the joined texts in which ``start`` and ``end`` count."""
    for rows, bases, parts in _grouped(texts, block, known.widest):
        which, place, start, end, hashed, joined = known.search(parts)
        base = bases[which]
        # A part after the first begins one character before its own.
        place = place + np.maximum(base - 1, 0)
        own = (place >= base) & (place < base + block)
        yield rows[which[own]], place[own], start[own], end[own], hashed[own], joined


def _grouped(texts: pa.Array, block: int, widest: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Texts in groups of about ``block`` characters: (row, base, part). A longer text is cut into parts
    that stand for ``block`` characters from ``base`` on, each with the character before it and
    enough of what follows to complete a title."""
    rows, bases, parts, size = [], [], [], 0
    for row, value in enumerate(texts):
        held = value.as_py() or ""
        for base in range(0, max(len(held), 1), block):
            if parts and size + min(len(held), block) > block:
                yield np.array(rows), np.array(bases), parts
                rows, bases, parts, size = [], [], [], 0
            part = held if len(held) <= block else held[max(base - 1, 0) : base + block + widest]
            rows.append(row)
            bases.append(base)
            parts.append(part)
            size += len(part)
    if parts:
        yield np.array(rows), np.array(bases), parts
