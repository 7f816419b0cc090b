"""Which stretches of a text may be titles: hashes of many stretches at once, in numpy.

The hash of a stretch is the difference of two running sums, scaled back to its first
character, so each costs the same whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from thicket.functions.text import WORD_CHAR, fold_case

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
# Three of 64 bits, from places of a hash that number no word of a filter.
_BIT_SHIFTS = (44, 50, 56)
_POINTS = 0x110000
# Stretches that are tested at once, all of one place at least: this bounds the arrays.
_SLAB = 1 << 17

# By application: tables of all code points.
_tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
_scales: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


@dataclass(frozen=True)
class TitleFilter:
    """What tasks know of all titles. ``offsets`` and ``sizes`` list by lead bucket the sizes that
    titles of that beginning have; ``masks`` is a Bloom filter of whole titles, or None. Characters
    are replaced by ``folded``, or left if that is None."""

    shortest: int
    widest: int
    offsets: np.ndarray
    sizes: np.ndarray
    masks: np.ndarray | None
    word_chars: np.ndarray | None
    folded: np.ndarray | None

    def search(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
        """(which, place, start, end, hash) of each stretch that may be a title, in order, and the joined
        texts: ``place`` counts in the text ``which``, ``start`` and ``end`` in the joined ones."""
        joined = "\n".join(texts) + "\n"
        points = _code_points(joined)
        if self.folded is not None:
            points = self.folded[points]
            joined = points.tobytes().decode("utf-32-le")
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        closes = np.cumsum(lengths + 1) - 1
        if self.word_chars is None:
            starts, ends = np.arange(len(points)), None
        else:
            # A unit is a run of word characters and the character after it.
            ends = np.flatnonzero(~self.word_chars[points])
            starts = np.concatenate(([0], ends[:-1] + 1))

        def end_of(unit: np.ndarray, size: np.ndarray | int) -> np.ndarray:
            if ends is None:
                return np.minimum(starts[unit] + size, len(points))
            # What is cut off here reaches beyond its text and is left out below.
            return ends[np.minimum(unit + size - 1, len(ends) - 1)]

        sums = _running_sums(points)
        lead = _hashes(sums, starts, end_of(np.arange(len(starts)), self.shortest))
        bucket = (lead & np.uint64(len(self.offsets) - 2)).astype(np.int64)
        first = self.offsets[bucket].astype(np.int64)
        before = np.concatenate(([0], np.cumsum(self.offsets[bucket + 1] - first)))

        def tested(a: int, b: int) -> tuple[np.ndarray, ...]:
            """(unit, size, start, end, hash) of what may be a title and begins at units from ``a`` to ``b``."""
            unit = np.repeat(np.arange(a, b), np.diff(before[a : b + 1]))
            size = self.sizes[np.arange(before[a], before[b]) + (first - before[:-1])[unit]]
            start, end = starts[unit], end_of(unit, size)
            hashed = _hashes(sums, start, end)
            if self.masks is None:
                return unit, size, start, end, hashed
            bits = _bits(hashed)
            kept = (self.masks[(hashed & np.uint64(len(self.masks) - 1)).astype(np.int64)] & bits) == bits
            return unit[kept], size[kept], start[kept], end[kept], hashed[kept]

        found = [tested(a, b) for a, b in slabs(before, _SLAB)]
        unit, size, start, end, hashed = (np.concatenate(column) for column in zip(*found, strict=True))
        which = np.searchsorted(closes, start)
        whole = unit + size <= len(ends) if ends is not None else start + size <= len(points)
        kept = whole & (end <= closes[which])
        which, start, end = which[kept], start[kept], end[kept]
        return which, start - (closes - lengths)[which], start, end, hashed[kept], joined


@dataclass(frozen=True)
class TitleOrder:
    """In what order titles are taken. ``hashes`` of the titles ascend; what the title ``i`` stands for
    lies from ``offsets[i]`` on: its rank among all entries, its number within the title and a hash
    of its target."""

    hashes: np.ndarray
    offsets: np.ndarray
    ranks: np.ndarray
    numbers: np.ndarray
    targets: np.ndarray

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(title, known): the number of the title with each hash, and whether there is one."""
        title = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        return title, self.hashes[title] == hashed


@dataclass(frozen=True)
class TitleNames:
    """The texts behind a ``TitleOrder``. ``targets`` lie like its entries; ``keys`` like its titles, null where
    a key is its first target, of ASCII alone, in lower case."""

    keys: pa.Array
    targets: pa.Array

    def key(self, title: int, first_entry: int) -> str:
        key = self.keys[title].as_py()
        return self.targets[first_entry].as_py().lower() if key is None else key


def character_tables(spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    """By code point, whether it continues a word and what it folds to, by the JVM's tables."""
    application = spark.sparkContext.applicationId
    if application not in _tables:
        codes = np.array([c for c in range(_POINTS) if not 0xD800 <= c <= 0xDFFF])
        rows = [("\n".join(map(chr, part)),) for part in np.array_split(codes, 256)]
        chars = F.col("chars")
        found = spark.createDataFrame(rows, "chars string").select(
            "chars", F.regexp_replace(chars, f"[{WORD_CHAR}]", "a"), fold_case(chars)
        )
        word_chars, folds = np.zeros(_POINTS, bool), np.arange(_POINTS, dtype=np.uint32)
        for given, marked, folded in found.collect():
            ids = _code_points(given[::2])
            word_chars[ids] = _code_points(marked[::2]) == ord("a")
            folds[ids] = _code_points(folded[::2])
        _tables[application] = word_chars, folds
    return _tables[application]


@F.arrow_udf(LongType())
def text_hash(texts: pa.Array) -> pa.Array:
    """The hash of each text, as ``TitleFilter`` takes it of a stretch."""
    held = texts.to_pylist()
    lengths = np.fromiter(map(len, held), np.int64, len(held))
    ends = np.cumsum(lengths)
    return pa.array(_hashes(_running_sums(_code_points("".join(held))), ends - lengths, ends).view(np.int64))


def filter_bits(hashed: Column) -> Column:
    """The bits of ``_bits``, of a hash in a column."""
    one = F.lit(1).cast("bigint")
    places = [F.shiftright(hashed, shift).bitwiseAND(F.lit(63)).cast("int") for shift in _BIT_SHIFTS]
    first, second, third = (F.call_function("shiftleft", one, place) for place in places)
    return first.bitwiseOR(second).bitwiseOR(third)


def slabs(before: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items, of which the first ``i`` hold ``before[i]``: each holds ``most``, or is one item."""
    a, stop = 0, len(before) - 1
    while a < stop:
        fits = int(np.searchsorted(before, before[a] + most, side="right")) - 1
        b = min(max(fits, a + 1), stop)
        yield a, b
        a = b


def _bits(hashed: np.ndarray) -> np.ndarray:
    one, low = np.uint64(1), np.uint64(63)
    first, second, third = (one << ((hashed >> np.uint64(shift)) & low) for shift in _BIT_SHIFTS)
    return first | second | third


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _running_sums(points: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _scale(0, len(points))[: len(points)], out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    mixed = (sums[ends] - sums[starts]) * _scale(1, len(sums))[starts]
    for factor in _MIX:
        mixed ^= mixed >> np.uint64(33)
        mixed *= factor
    return mixed ^ (mixed >> np.uint64(33))


def _scale(inverse: int, count: int) -> np.ndarray:
    """Powers of the base, or of its inverse, modulo 2^64: at least ``count``."""
    if len(_scales[inverse]) < count:
        factors = np.full(max(count, 1 << 18), _INVERSE if inverse else _BASE, np.uint64)
        factors[0] = 1
        _scales[inverse] = np.cumprod(factors)
    return _scales[inverse]
