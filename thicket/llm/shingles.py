"""Word shingles of texts: exact sets, and a 64-bit token for each shingle.

Words are told apart by their bytes, never by a hash: each gets a number, and
shingles are told apart by the numbers of their words. So set sizes are exact.
Tokens are hashes that all tasks compute alike, for joins that propose pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_KNOWN_WORDS = 1 << 20
_SEED = 0x7468
_U64 = np.uint64
_FACTOR = _U64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Bytes are split at ASCII white space and lower-cased in A-Z only."""
    return text.encode().lower().split()


def portions(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of some ``most`` characters of text each."""
    start = size = 0
    for i, text in enumerate(batch.column("text")):
        size += len(text.as_py() or "")
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


class _Numbers(dict):
    """A number for each word, and the hashes of the words in that order."""

    def __init__(self) -> None:
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word, _SEED))
        return number


class Shingler:
    """Distinct shingles of texts, as tokens; keeps the words it has met, up to a bound."""

    def __init__(self, width: int):
        self.width = width
        self.numbers = _Numbers()
        self.hashes = np.empty(0, np.uint64)

    def tokens(self, words: list[bytes]) -> tuple[int, np.ndarray]:
        """How many distinct shingles there are, and their tokens in ascending order.

        Fewer words than the width are one shingle. Shingles of equal tokens, should there
        be any, count each but have one token.
        """
        if not words:
            return 0, np.empty(0, np.uint64)
        if len(self.numbers) > _KNOWN_WORDS:
            self.numbers, self.hashes = _Numbers(), np.empty(0, np.uint64)
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if len(self.hashes) < len(self.numbers):
            fresh = np.array(self.numbers.hashes[len(self.hashes) :], np.uint64)
            self.hashes = np.concatenate([self.hashes, fresh])
        width = min(self.width, len(words))
        hashes = self.hashes[numbers]
        total = np.full(len(words) - width + 1, width, np.uint64)
        for i in range(width):
            total ^= hashes[i : i + len(total)]
            total *= _FACTOR
            total ^= total >> _U64(29)
        return distinct_runs(numbers, width), distinct(mixed(total))


def distinct_runs(numbers: np.ndarray, width: int) -> int:
    """How many different runs of ``width`` numbers there are."""
    count = len(numbers) - width + 1
    codes, bound = numbers[:count], int(numbers.max()) + 1
    base = bound
    for i in range(1, width):
        if bound > (1 << 62) // base:  # codes would not fit: number those there are
            codes = np.unique(codes, return_inverse=True)[1]
            bound = int(codes.max()) + 1
        codes = codes * base + numbers[i : i + count]
        bound *= base
    return len(distinct(codes))


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in ascending order; for short arrays faster than numpy's own."""
    ordered = np.sort(values)
    first = np.empty(len(ordered), bool)
    first[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return ordered[first]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))
