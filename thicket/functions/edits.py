"""Links of whole batches of texts, written and shown: one pass over each text, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from thicket.functions.text import CONTEXT_WIDTH

# The white space of ECMAScript, as in ``text.SPACE``.
_SPACE = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_NAMES = ["target", "matched_text", "line", "context", "start", "end", "replacement"]
_SHOWN = StructType([StructField(n, LongType() if n in ("line", "start", "end") else StringType()) for n in _NAMES])


SHOWN, WRITTEN = ArrayType(_SHOWN), "struct<content:string,n_applied:bigint>"


@F.arrow_udf(SHOWN)
def described(texts: pa.Array, edits: pa.Array) -> pa.Array:
    """Each edit (start, end, target; in order) of a text with what a reviewer sees of it."""
    return show(texts, edits)


@F.arrow_udf(StringType())
def linked(texts: pa.Array, edits: pa.Array) -> pa.Array:
    """The texts with their edits (start, end, target; in order and apart) written."""
    return pa.array(_written(texts, edits), pa.string())


def show(texts: pa.Array, edits: pa.Array) -> pa.Array:
    """What ``described`` gives."""
    rows, counts = [], [0]
    for text, found in _by_text(texts, edits):
        line, seen = 1, 0
        for start, end, target in found:
            line += text.count("\n", seen, start)
            seen = start
            matched = text[start:end]
            rows.append((target, matched, line, _context(text, start, end), start, end, _wikilink(target, matched)))
        counts.append(len(rows))
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    shown = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), shown)


def write(texts: pa.Array, edits: pa.Array) -> pa.Array:
    """(content, n_applied): the texts with their edits written, null where there are none."""
    counts = edits.value_lengths().to_pylist()
    written = [text if count else None for text, count in zip(_written(texts, edits), counts, strict=True)]
    return pa.StructArray.from_arrays([pa.array(written, pa.string()), pa.array(counts, pa.int64())], ["content", "n_applied"])


def _written(texts: pa.Array, edits: pa.Array) -> Iterator[str]:
    for text, found in _by_text(texts, edits):
        pieces, at = [], 0
        for start, end, target in found:
            pieces += text[at:start], _wikilink(target, text[start:end])
            at = end
        pieces.append(text[at:])
        yield "".join(pieces)


def _by_text(texts: pa.Array, edits: pa.Array) -> Iterator[tuple[str, Iterator[tuple[int, int, str]]]]:
    bounds, values = edits.offsets.to_pylist(), edits.values
    base = bounds[0]
    held = values.slice(base, bounds[-1] - base)
    starts, ends, targets = (held.field(name).to_pylist() for name in ("start", "end", "target"))
    for row, text in enumerate(texts):
        own = slice(bounds[row] - base, bounds[row + 1] - base)
        yield text.as_py() or "", zip(starts[own], ends[own], targets[own], strict=True)


def _context(text: str, start: int, end: int) -> str:
    # One character more than is shown tells whether the line goes on.
    before = text[max(start - CONTEXT_WIDTH - 1, 0) : start].rpartition("\n")[2]
    after = text[end : end + CONTEXT_WIDTH + 1].partition("\n")[0]
    if len(before) > CONTEXT_WIDTH:
        before = "…" + before[-CONTEXT_WIDTH:]
    if len(after) > CONTEXT_WIDTH:
        after = after[:CONTEXT_WIDTH] + "…"
    return f"{before}**{text[start:end]}**{after}".strip(_SPACE)


def _wikilink(target: str, matched: str) -> str:
    return f"[[{target}]]" if matched == target else f"[[{target}|{matched}]]"
