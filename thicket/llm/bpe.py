"""Byte-level BPE encoding and decoding by merge replay over a corpus of words.

The text is cut into matches of the vocabulary's pattern. The distinct new ones
of a slab of text form a small corpus: one array of symbols, and an index from
the rank of a mergeable pair to the positions where it stands. Ranks are taken in
order; each is applied to all words at once, and only the two neighbours of a
merged pair are looked up again. A match that is itself in the vocabulary is one
token, as the usual encoder has it.

Documents are read in Arrow batches where they lie; nothing is shuffled or
joined, since a word costs less to replay than to send. A task holds one slab of
at most ``SLAB`` matches (of a huge text, a part of its matches at a time) and a
cache of at most ``CACHE`` words.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SLAB = 1_500_000
CACHE = 400_000
_NONE = 1 << 40


class Vocabulary:
    """Ranks of byte strings, read from a file of base64 and rank per line."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = {rank: data for data, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self._single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = sorted(
            (self.ranks[data[:i]] << 32 | self.ranks[data[i:]], rank)
            for data, rank in self.ranks.items()
            for i in range(1, len(data))
            if data[:i] in self.ranks and data[i:] in self.ranks
        )
        self._keys = np.array([key for key, _ in pairs], np.int64)
        self._ranks = np.array([rank for _, rank in pairs], np.int32)
        self._words: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def encode(self, texts: Iterable[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i, ids in self.encode_slabs(texts):
            while len(out) <= i:
                out.append([])
            out[i].extend(ids)
        return out

    def encode_slabs(self, texts: Iterable[str]) -> Iterator[tuple[int, list[int]]]:
        """Number of a text and its next ids; each text appears at least once, in order."""
        slab, size = [], 0
        for i, text in enumerate(texts):
            for part in self._matches(text):
                slab.append((i, part))
                size += len(part)
                if size >= SLAB:
                    yield from self._encoded(slab)
                    slab, size = [], 0
        yield from self._encoded(slab)

    def _matches(self, text: str) -> Iterator[list[str]]:
        """The matches of a text, those of a huge one in parts."""
        if len(text) < SLAB:
            yield self.pattern.findall(text)
            return
        matches = (m[0] for m in self.pattern.finditer(text))
        while part := list(islice(matches, SLAB)):
            yield part

    def _encoded(self, slab: list[tuple[int, list[str]]]) -> Iterator[tuple[int, list[int]]]:
        if len(self._words) > CACHE:
            self._words, self._older = {}, self._words
        known, older = self._words, self._older
        new = []
        for word in set().union(*(part for _, part in slab)).difference(known):
            if word in older:
                known[word] = older[word]
            else:
                new.append(word)
        known.update(zip(new, self.replay([w.encode() for w in new])))
        for i, part in slab:
            yield i, list(chain.from_iterable(map(known.__getitem__, part)))

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The tokens of each word.

        All places of one rank merge at once. That equals taking the lowest rank of
        each word in turn as long as a merge never makes a pair of lower rank. Words
        where one does are done again on their own.
        """
        if not words:
            return []
        known = np.array([self.ranks.get(w, -1) for w in words], np.int32)
        lengths = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(lengths) - lengths
        letters = self._single[np.frombuffer(b"".join(words), np.uint8)]
        letters[first[known >= 0]] = known[known >= 0]
        sizes = np.where(known >= 0, 1, lengths)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        symbol = letters[np.arange(ends[-1]) + np.repeat(first - starts, sizes)]
        after = np.arange(1, len(symbol) + 1)
        before = np.arange(-1, len(symbol) - 1)
        after[ends - 1] = before[starts] = -1
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        waiting: list[int] = []

        def add(places: np.ndarray, rank: int) -> np.ndarray:
            """Enter mergeable pairs into the index; which of them come too late."""
            ranks = self._pair_ranks(symbol[places], symbol[after[places]])
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for part, of in zip(np.split(places, cuts), ranks[np.r_[0, cuts]].tolist() if len(ranks) else ()):
                if of not in index:
                    heappush(waiting, of)
                index[of].append(part)
            return places[ranks < rank]

        add(np.flatnonzero(after >= 0), -1)
        late = [np.empty(0, np.int64)]
        while waiting:
            rank = heappop(waiting)
            at = np.unique(np.concatenate(index.pop(rank)))
            at = at[(symbol[at] >= 0) & (after[at] >= 0)]
            at = at[self._pair_ranks(symbol[at], symbol[after[at]]) == rank]
            at = _leftmost(at, after[at])
            to = after[at]
            beyond = after[to]
            symbol[at], symbol[to], after[at] = rank, -1, beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            left = before[at]
            late.append(add(np.concatenate([left[left >= 0], at[beyond >= 0]]), rank))
        again = set(np.searchsorted(ends, np.concatenate(late), side="right").tolist())
        alive = symbol >= 0
        counts = np.add.reduceat(alive, starts)
        tokens, upto = symbol[alive].tolist(), np.cumsum(counts).tolist()
        out, start = [], 0
        for end in upto:
            out.append(tuple(tokens[start:end]))
            start = end
        for i in again:
            out[i] = self._one_by_one(words[i])
        return out

    def _one_by_one(self, word: bytes) -> tuple[int, ...]:
        """The lowest rank, leftmost place, again and again."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == _NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return tuple(self.ranks[p] for p in parts)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of symbols merges into, or -1."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], -1)


def _leftmost(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Of places in order, those left when each takes its follower from the next."""
    clash = to[:-1] == at[1:]
    if not clash.any():
        return at
    taken, out = -1, []
    for place, follower in zip(at.tolist(), to.tolist()):
        if place != taken:
            out.append(place)
            taken = follower
    return np.array(out)



@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per worker process; the file must be at ``path`` on every node."""
    return Vocabulary(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids``: the token ids of every text, one row per input row.

    Null and empty texts have no ids. Rows keep their place; repeated rows are
    encoded each for itself. Columns other than ``doc_id`` and ``text`` are
    ignored. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for ids, texts in _pieces(batches):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(words.encode(texts), pa.list_(pa.int32()))], ["doc_id", "ids"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, data``: the bytes that ``encode`` read. Null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in batches:
            data = [words.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"]
            )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` without holding a text's ids at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for ids, texts in _pieces(batches):
            count = [0] * len(texts)
            listed = [hashlib.sha256() for _ in texts]
            decoded = [hashlib.sha256() for _ in texts]
            for i, tokens in words.encode_slabs(texts):
                if tokens:
                    listed[i].update(("," * (count[i] > 0) + ",".join(map(str, tokens))).encode())
                    decoded[i].update(words.decode(tokens))
                    count[i] += len(tokens)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(count, pa.int64()),
                    pa.array([h.hexdigest() for h in listed]),
                    pa.array([h.hexdigest() for h in decoded]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[tuple[pa.Array, list[str]]]:
    """A few rows at a time: their ids and texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part.column("doc_id"), [t or "" for t in part.column("text").to_pylist()]
