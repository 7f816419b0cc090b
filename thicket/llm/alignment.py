"""Which tokens of two tokenizers cover the same bytes, and how often over a corpus.

Both tokenizers say where their tokens lie: one in characters, the other in
bytes of the text. Such a span is only a coarse cut. A character of several
bytes may be shared by tokens that all claim the whole of it, and a byte-fallback
piece claims nothing of its own. Between two coarse cuts the decoded bytes of
the tokens say where each ends. Byte offsets where tokens of both sides end cut
the two sequences into groups; every token of a group is linked with every token
of the other side in it.

A text is encoded in chunks, cut before each space that follows a character
other than white space. Neither side can merge across such a cut: the first
side's pattern ends a match there, and no piece of the second has a space after
another character (checked when the model is loaded; if one has, or a text holds
the sign that stands for a space, texts are encoded whole). Chunks repeat, so each
task keeps those it has seen, up to a bound, and encodes new ones many at a time.

Scale: one pass over the texts writes each document's distinct pairs of ids. They
are counted with partial sums, so a pair that all documents hold is one row a
task. The counts go back by a broadcast below ``BROADCAST_BYTES``, measured, and
by a salted join above.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from thicket.durable import stored
from thicket.llm.rows import ROW, salted_join

BROADCAST_BYTES = 96 << 20  # of the table of counts, at _COUNT_BYTES a row
_COUNT_BYTES = 48
_KEPT_CHUNKS, _KEPT_PAIRS = 500_000, 5_000_000
_PORTION = 1 << 16  # characters encoded at once
_DENSE = 1 << 16  # links of a group above which equal ids are put together first
_CUT = re.compile(r"(?<=\S)(?= .)", re.DOTALL)  # the model adds no space to an empty text
_SPACE_SIGN = "▁"
_FACTS = ["n_a", "n_b", "n_groups", "n_links"]


def align(docs: DataFrame, json_file: str, model_file: str) -> DataFrame:
    """One row per input row: ``_thicket_row, doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256``.

    Side a is the tokenizer of ``json_file`` on a space and the text, side b the model
    of ``model_file``, which adds that space itself; neither adds special tokens.
    Texts that are null or empty, or that either side cannot give back byte by byte, have
    no tokens: zeros and an empty ``groups_sha256``. A pair's count is the number of
    rows that hold it linked; rows that repeat a document count each. ``n_best`` counts
    links whose pair has the highest count of its id of side a, ``count_sum`` adds up
    the counts of all links. Other columns are ignored; an empty table gives no rows.
    """
    return counted(stored(aligned(docs, json_file, model_file)))


def counted(found: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``aligned`` documents with the counts of their pairs over all of them."""
    counts = found.select(F.explode("pairs.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    counts = stored(counts)
    side_a = F.shiftright("pair", 32).alias("a")
    highest = counts.groupBy(side_a).agg(F.max("count").alias("highest"))
    weights = stored(
        counts.withColumn("a", side_a)
        .join(highest, "a")
        .select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    )
    links = found.select(ROW, F.inline("pairs"))
    if weights.count() * _COUNT_BYTES <= broadcast_bytes:
        weighed = links.join(F.broadcast(weights), "pair")
    else:
        weighed = salted_join(links, weights, ["pair"], F.col(ROW))
    sums = weighed.groupBy(ROW).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    )
    nothing = F.lit(0).cast("bigint")
    return (
        found.drop("pairs")
        .join(sums, ROW, "left")
        .select(
            ROW, "doc_id", *_FACTS,
            F.coalesce("n_best", nothing).alias("n_best"),
            F.coalesce("count_sum", nothing).alias("count_sum"),
            "groups_sha256",
        )
    )


def aligned(docs: DataFrame, json_file: str, model_file: str) -> DataFrame:
    """``_thicket_row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` and ``pairs``: the
    distinct linked pairs, ``a << 32 | b``, each with its number of links."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keep = ROW if ROW in docs.columns else F.monotonically_increasing_id().alias(ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Aligner(json_file, model_file)
        for batch in batches:
            for part in _portions(batch):
                yield _record(part, pair.documents([t.as_py() for t in part.column("text")]))

    return docs.select(keep, "doc_id", "text").mapInArrow(
        run,
        f"{ROW} bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint,"
        " groups_sha256 string, pairs array<struct<pair:bigint,times:bigint>>",
    )


def groups(text: str, json_file: str, model_file: str) -> list[tuple[list[int], list[int]]]:
    """The groups of one text: ids of side a and of side b."""
    written = Aligner(json_file, model_file).written(text)
    sides = (group.split("|") for group in written.split(";")) if written else ()
    return [tuple([int(i) for i in side.split(",")] for side in both) for both in sides]


def _portions(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    start = size = 0
    for i, text in enumerate(batch.column("text")):
        size += len(text.as_py() or "")
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _record(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    facts, digests, pairs, times = zip(*rows)
    columns = [pa.array([f[k] for f in facts], pa.int64()) for k in range(len(_FACTS))]
    bounds = np.cumsum([0, *map(len, pairs)]).astype(np.int32)
    links = pa.StructArray.from_arrays(
        [pa.array(np.concatenate(pairs)), pa.array(np.concatenate(times))], ["pair", "times"]
    )
    return pa.RecordBatch.from_arrays(
        [batch.column(ROW), batch.column("doc_id"), *columns, pa.array(digests, pa.string()),
         pa.ListArray.from_arrays(pa.array(bounds), links)],
        [ROW, "doc_id", *_FACTS, "groups_sha256", "pairs"],
    )


class Aligner:
    """Both tokenizers and the chunks that this task has seen."""

    def __init__(self, json_file: str, model_file: str):
        self.first = Tokenizer.from_file(json_file)
        self.first.encode_special_tokens = True  # their strings in a text are ordinary text
        self.second = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bytes_a = _decoded_entries(self.first)
        self.bytes_b = [_decoded_piece(self.second, i) for i in range(self.second.get_piece_size())]
        self.widths_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.widths_b = np.array([len(b) for b in self.bytes_b], np.int64)
        self.names_a, self.names_b = _names(len(self.bytes_a), "|"), _names(len(self.bytes_b), ";")
        pieces = map(self.second.id_to_piece, range(self.second.get_piece_size()))
        self.cut = not any(_SPACE_SIGN in piece.lstrip(_SPACE_SIGN) for piece in pieces)
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.facts = np.zeros((1024, 4), np.int64)
        self.valid: list[bool] = []
        self.texts: list[str] = []
        self.starts = np.zeros(1025, np.int64)  # of each chunk's pairs
        self.pairs = np.zeros(8192, np.int64)
        self.times = np.zeros(8192, np.int64)

    def written(self, text: str | None) -> str:
        """The groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        places = self._learned([text])[0]
        if not places or not all(self.valid[p] for p in places):
            return ""
        return ";".join([self.texts[p] for p in places])

    def documents(self, texts: list[str | None]) -> list[tuple]:
        """Per text: counts, digest of the groups, distinct pairs and their links."""
        nothing = np.zeros(0, np.int64)
        out = []
        for places in self._learned(texts):
            if not places or not all([self.valid[p] for p in places]):
                out.append(((0, 0, 0, 0), "", nothing, nothing))
                continue
            digest = hashlib.sha256(";".join([self.texts[p] for p in places]).encode()).hexdigest()
            chunks, repeats = np.unique(np.array(places), return_counts=True)
            facts = (self.facts[chunks] * repeats[:, None]).sum(axis=0).tolist()
            first, sizes = self.starts[chunks], self.starts[chunks + 1] - self.starts[chunks]
            at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            out.append((facts, digest, *_summed(self.pairs[at], self.times[at] * np.repeat(repeats, sizes))))
        return out

    def _learned(self, texts: list[str | None]) -> list[list[int]]:
        """The places of each text's chunks, all of them known now."""
        if len(self.places) > _KEPT_CHUNKS or self.starts[len(self.places)] > _KEPT_PAIRS:
            self._forget()
        split = [self._chunks(text) for text in texts]
        fresh = list(dict.fromkeys(c for chunks in split for c in chunks if c not in self.places))
        portion, size = [], 0
        for chunk in fresh:
            if chunk[-1].isspace():  # the end of a text; behind another chunk it would be read otherwise
                self._learn([chunk])
                continue
            portion.append(chunk)
            size += len(chunk)
            if size >= _PORTION:
                self._learn(portion)
                portion, size = [], 0
        if portion:
            self._learn(portion)
        return [[self.places[c] for c in chunks] for chunks in split]

    def _chunks(self, text: str | None) -> list[str]:
        if not text:
            return []
        whole = " " + text
        return _CUT.split(whole) if self.cut and _SPACE_SIGN not in text else [whole]

    def _learn(self, chunks: list[str]) -> None:
        """Encode some chunks in one text; in halves if that is not given back."""
        text = "".join(chunks)
        data = text.encode()
        encoding = self.first.encode(text, add_special_tokens=False)
        ids_a = encoding.ids
        if b"".join([self.bytes_a[i] for i in ids_a]) == data:
            spans = [(p.id, p.begin, p.end) for p in self.second.encode(text[1:], return_type="proto").pieces]
            if b"".join([self.bytes_b[i] for i, _, _ in spans]) == data:
                a, b = np.array(ids_a, np.int64), _table(spans, 3)
                coarse_a = _in_bytes(text, data, _table(encoding.offsets, 2))
                coarse_b = b[:, 1:] + 1
                coarse_b[0, 0] = 0  # the space that the model adds is the text's first byte here
                b = b[:, 0]
                ends_a = exact_ends(coarse_a, self.widths_a[a])
                ends_b = exact_ends(coarse_b, self.widths_b[b])
                self._keep(chunks, len(data) == len(text), a, b, ends_a, ends_b)
                return
        if len(chunks) == 1:
            nothing = np.zeros(0, np.int64)
            self._add(chunks, False, np.zeros((1, 4), np.int64), [""], nothing, nothing, np.zeros(1, np.int64))
            return
        half = len(chunks) // 2
        self._learn(chunks[:half])
        self._learn(chunks[half:])

    def _keep(
        self, chunks: list[str], plain: bool, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray
    ) -> None:
        ends = np.cumsum(list(map(len, chunks)) if plain else [len(c.encode()) for c in chunks])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        upto_a = np.searchsorted(ends_a, cuts, "right")
        upto_b = np.searchsorted(ends_b, cuts, "right")
        n_a, n_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        pairs, times, held = _linked(a, b, upto_a, upto_b, n_a, n_b)
        last = np.searchsorted(cuts, ends, "right")  # groups up to each chunk's end
        sums = np.cumsum(np.stack([n_a, n_b, np.ones_like(n_a), n_a * n_b], axis=1), axis=0)
        facts = np.diff(sums[last - 1], axis=0, prepend=0)
        # Tokens in the order of writing: of each group side a, then side b.
        order = np.empty(len(a) + len(b), object)
        final_a, final_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        final_a[upto_a - 1] = final_b[upto_b - 1] = 1
        order[np.arange(len(a)) + np.repeat(upto_b - n_b, n_a)] = self.names_a[final_a, a]
        order[np.arange(len(b)) + np.repeat(upto_a, n_b)] = self.names_b[final_b, b]
        names, bounds = order.tolist(), (upto_a + upto_b)[last - 1].tolist()
        written = ["".join(names[i:j])[:-1] for i, j in zip([0, *bounds], bounds)]
        self._add(chunks, True, facts, written, pairs, times, np.cumsum(held)[last - 1])

    def _add(
        self, chunks: list[str], valid: bool, facts: np.ndarray, written: list[str], pairs: np.ndarray,
        times: np.ndarray, upto: np.ndarray,
    ) -> None:
        place, after = len(self.places), len(self.places) + len(chunks)
        start = int(self.starts[place])
        while after >= len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
            self.starts = np.concatenate([self.starts, np.zeros(len(self.starts) - 1, np.int64)])
        while start + len(pairs) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
            self.times = np.concatenate([self.times, np.zeros_like(self.times)])
        self.places.update(zip(chunks, range(place, after)))
        self.facts[place:after] = facts
        self.valid.extend([valid] * len(chunks))
        self.texts.extend(written)
        self.pairs[start : start + len(pairs)] = pairs
        self.times[start : start + len(pairs)] = times
        self.starts[place + 1 : after + 1] = start + upto


def _table(rows: list[tuple], width: int) -> np.ndarray:
    flat = np.fromiter(chain.from_iterable(rows), np.int64, width * len(rows))
    return flat.reshape(-1, width)


def _names(size: int, end: str) -> np.ndarray:
    """Each id with a comma, and with the sign that ends its side of a group."""
    return np.array([[f"{i}{sign}" for i in range(size)] for sign in (",", end)], object)


def exact_ends(spans: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Where each token ends, in bytes.

    ``spans`` are claimed starts and ends. A token whose claimed end is the claimed
    start of the next, and no earlier than any claim before it, ends there: a coarse
    cut. Tokens between two such cuts claim the same characters; they end where the
    decoded ``widths`` since the first cut say. Widths also decide where they
    contradict a cut.
    """
    by_bytes = np.cumsum(widths)
    if not len(widths):
        return by_bytes
    starts, ends = spans[:, 0], np.maximum.accumulate(spans[:, 1])
    clean = np.append(ends[:-1] == starts[1:], True) & (ends == by_bytes)
    last_cut = np.maximum.accumulate(np.where(clean, np.arange(len(widths)), -1))
    run = np.where(last_cut < 0, 0, ends[last_cut])  # the byte at which a token's run began
    inside = by_bytes - np.where(last_cut < 0, 0, by_bytes[last_cut])
    return run + inside


def _in_bytes(text: str, data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Offsets in characters as offsets in UTF-8."""
    if len(text) == len(data):
        return offsets
    array = np.frombuffer(data, np.uint8)
    starts = np.append(np.flatnonzero((array & 0xC0) != 0x80), len(data))
    return starts[offsets]


def _linked(
    a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, their links, and how many pairs each group has. Large groups hold each pair once."""
    sizes = n_a * n_b
    if len(sizes) and sizes.max() > _DENSE:
        parts = []
        for i, k, j, m in zip(upto_a - n_a, upto_a, upto_b - n_b, upto_b):
            (ids_a, count_a), (ids_b, count_b) = (np.unique(x, return_counts=True) for x in (a[i:k], b[j:m]))
            parts.append(((ids_a[:, None] << 32 | ids_b).ravel(), (count_a[:, None] * count_b).ravel()))
        pairs, times = (np.concatenate(column) for column in zip(*parts))
        return pairs, times, np.array([len(p) for p, _ in parts])
    group = np.repeat(np.arange(len(sizes)), sizes)
    nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = (upto_a - n_a)[group] + nth // n_b[group]
    right = (upto_b - n_b)[group] + nth % n_b[group]
    pairs = a[left] << 32 | b[right]
    return pairs, np.ones(len(pairs), np.int64), sizes


def _summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs)
    pairs, times = pairs[order], times[order]
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    return pairs[first], np.add.reduceat(times, first)


def _decoded_entries(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of each entry. Byte-level vocabularies write printable Latin-1 as it is and
    the other bytes, in order, as the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [value for value in range(256) if value not in set(plain)]
    value_of = {chr(v): v for v in plain} | {chr(256 + i): v for i, v in enumerate(other)}
    size = tokenizer.get_vocab_size()
    entries = [tokenizer.id_to_token(i) or "" for i in range(size)]
    return [bytes(value_of[c] for c in e) if all(c in value_of for c in e) else e.encode() for e in entries]


def _decoded_piece(model: sentencepiece.SentencePieceProcessor, i: int) -> bytes:
    piece = model.id_to_piece(i)
    if model.is_byte(i):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(_SPACE_SIGN, " ").encode()
