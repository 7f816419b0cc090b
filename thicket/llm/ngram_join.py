"""Documents whose n-gram sets are similar, by a grouped prefix join.

All sets are written in one order of their tokens, rare ones first. Two sets that
are similar enough share a token among the first few of each, its prefix.
Documents whose prefixes and sizes are the same form one group; groups meet on
the tokens of their prefixes, and pairs of groups that cannot be similar, by
their sizes or by how few tokens their prefixes share, are dropped. What is left is
expanded to the members, and these are verified on their full sets.

Only links between components are looked for. A token or a group with over
``CROWD`` members is not listed as pairs: its members go through hubs (see
``minhash.connecting_links``), which confirm the same links with work linear in
the members and in what these have in common beyond a hub. Pairs of the others
are verified first with the smallest partner of each document, then between
components that this leaves apart.

The order comes from counts of all tokens, kept in a table of cells per task and
summed: a broadcast of one byte a cell. There are as many cells as an eighth of the
tokens, at most ``MOST_CELLS``. Cells shared by several tokens only make the order
coarser; any order gives the same links.

Scale: texts are read twice, for counts and for prefixes. A prefix holds about
``100 - percent`` per cent of the tokens; all joins work on these and on numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.durable import durable, release, stored
from thicket.llm.components import components
from thicket.llm.minhash import by_component, confirm, connecting_links, texts_of
from thicket.llm.rows import ROW, with_row_ids
from thicket.llm.shingles import Shingler, distinct, portions, words_of

SHINGLE = 5
PERCENT = 80
CROWD = 8  # members of a token or group up to which pairs are listed
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 26
_BYTES_A_CELL = 48  # of text: eight words or so
_SLICE = 1 << 16  # cells that a task hands over in one row
_U64 = np.uint64


def linked_documents(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, crowd: int = CROWD
) -> DataFrame:
    """One row per input row: ``_thicket_row, doc_id, n_shingles, component_id, kept``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document's set is its
    distinct shingles of ``shingle`` words, or its whole sequence if it has fewer.
    Documents with ``100 * common >= percent * all`` are linked. ``component_id`` is
    the smallest ``doc_id`` reachable (null ids count as largest) and the row that has
    it is ``kept``; of rows that repeat it, one. Null texts and texts without words
    have no shingles and no links. Other columns are ignored; an empty table gives no
    rows.
    """
    keyed = with_row_ids(docs, "doc_id", "text")
    cells = _cells(keyed)
    counted = stored(_counted(keyed, shingle, cells))
    sketched = counted.filter("cells IS NULL").select(ROW, "doc_id", "n_shingles", "same")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    classes = durable(
        sketched.filter("n_shingles > 0").groupBy("same").agg(F.min(order).alias("m")).select(
            "same", F.col(f"m.{ROW}").alias("node")
        )
    )
    prefixes = _prefixes(keyed, _token_order(counted, cells), shingle, percent)
    groups = stored(prefixes.join(classes.select("node"), "node", "left_semi"))
    links = _links(groups, keyed, shingle, percent, crowd)
    return by_component(sketched, classes, components(links))


def _cells(keyed: DataFrame) -> int:
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = LEAST_CELLS
    while cells < MOST_CELLS and cells * _BYTES_A_CELL < size:
        cells *= 2
    return cells


def _counted(keyed: DataFrame, width: int, count: int) -> DataFrame:
    """Set size and digest of the words of each row; then each task's counts of tokens by cell."""
    kind = keyed.schema["doc_id"].dataType.simpleString()
    names = [ROW, "doc_id", "n_shingles", "same", "slice", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, cells = Shingler(width), np.zeros(count, np.uint8)
        held: list[np.ndarray] = []
        doc_id = None
        for batch in batches:
            for part in portions(batch):
                sizes, same = [], []
                for text in part.column("text"):
                    words = words_of(text.as_py() or "")
                    size, tokens = shingler.tokens(words)
                    sizes.append(size)
                    same.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                    held.append(tokens)
                _count(cells, held)
                doc_id = part.column("doc_id")
                nothing = pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(ROW), doc_id, pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), *nothing], names
                )
        for at in range(0, count if doc_id is not None else 0, _SLICE):
            part = zstandard.compress(cells[at : at + _SLICE].tobytes(), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, doc_id.type), pa.nulls(1, pa.int64()),
                 pa.nulls(1, pa.binary()), pa.array([at // _SLICE], pa.int32()), pa.array([part], pa.binary())],
                names,
            )

    return keyed.select(ROW, "doc_id", "text").mapInArrow(
        run, f"{ROW} bigint, doc_id {kind}, n_shingles bigint, same binary, slice int, cells binary"
    )


def _count(cells: np.ndarray, held: list[np.ndarray]) -> None:
    """Add the tokens of one portion to their cells; a task counts up to 255."""
    found = np.sort((np.concatenate(held) & _U64(len(cells) - 1)).astype(np.int64))
    held.clear()
    if len(found):
        starts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        times = np.diff(np.append(starts, len(found)))
        cells[found[starts]] = np.minimum(cells[found[starts]] + times, 255).astype(np.uint8)


def _token_order(counted: DataFrame, count: int) -> np.ndarray:
    """For each cell how frequent its tokens are, in 256 steps: an eighth of a doubling each."""

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(_SLICE, np.uint64)
        for batch in batches:
            for part in batch.column("cells"):
                cells += np.frombuffer(zstandard.decompress(part.as_py()), np.uint8)
        steps = np.minimum(np.round(8 * np.log2(cells + 1.0)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([steps.tobytes()])], ["slice", "steps"])

    tables = counted.filter("cells IS NOT NULL").select("slice", "cells")
    order = np.zeros(count, np.uint8)
    for row in tables.groupBy("slice").applyInArrow(total, "slice int, steps binary").collect():
        order[row["slice"] * _SLICE : (row["slice"] + 1) * _SLICE] = np.frombuffer(row["steps"], np.uint8)
    return order


def prefix_size(n: int, percent: int) -> int:
    """First tokens of a set of ``n``, of which a similar set shares one."""
    return n - (percent * n + 99) // 100 + 1


def _prefixes(keyed: DataFrame, order: np.ndarray, width: int, percent: int) -> DataFrame:
    """``node, n, prefix, alike``: size, first tokens in the order, and a digest of both."""
    steps = keyed.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for part in portions(batch):
                nodes, sizes, prefixes, alike = [], [], [], []
                for node, text in zip(part.column(ROW).to_pylist(), part.column("text")):
                    size, tokens = shingler.tokens(words_of(text.as_py() or ""))
                    if not size:
                        continue
                    first = first_tokens(size, tokens, steps.value, percent)
                    nodes.append(node)
                    sizes.append(size)
                    prefixes.append(first)
                    alike.append(hashlib.blake2b(first.tobytes() + size.to_bytes(8, "big"), digest_size=16).digest())
                bounds = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.int64), *prefixes])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)), pa.array(alike, pa.binary())],
                    ["node", "n", "prefix", "alike"],
                )

    return keyed.select(ROW, "text").mapInArrow(run, "node bigint, n bigint, prefix array<bigint>, alike binary")


def first_tokens(size: int, tokens: np.ndarray, steps: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a set of ``size``; its order is the same for all sets: by step, then by hash."""
    rank = (steps[(tokens & _U64(len(steps) - 1)).astype(np.int64)].astype(np.uint64) << _U64(56)) | (tokens >> _U64(8))
    rank = distinct(rank)
    # Different shingles of one rank would leave fewer common ranks than common shingles.
    count = min(len(rank), prefix_size(size, percent) + size - len(rank))
    return rank[:count].view(np.int64)


def _links(groups: DataFrame, keyed: DataFrame, shingle: int, percent: int, crowd: int) -> DataFrame:
    """``a, b``: confirmed links that connect all nodes that any confirmed links connect."""
    heads = durable(groups.groupBy("alike").agg(F.min("node").alias("group"), F.count("*").alias("m")))
    members = stored(groups.select("alike", "node", "n").join(heads, "alike").drop("alike"))
    first = groups.join(heads.select(F.col("group").alias("node"), "m"), "node").select(
        F.col("node").alias("group"), "n", "m", F.size("prefix").alias("p"), "prefix"
    )
    posted = first.select("group", "m", F.explode("prefix").alias("token"))
    tokens = posted.groupBy("token").agg(F.count("*").alias("groups"), F.sum("m").alias("all"))
    tokens = stored(tokens.filter("groups > 1").select("token", (F.col("all") > crowd).alias("crowded")))
    shared = stored(posted.select("group", "token").join(tokens, "token"))
    release(groups.sparkSession)
    quiet, crowded = shared.filter("NOT crowded").drop("crowded"), shared.filter("crowded").drop("crowded")
    pairs = stored(_member_pairs(_group_pairs(quiet, crowded, first.drop("prefix"), percent), members, crowd))
    banded = _crowds(members, crowded, crowd)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(banded.select("node")).distinct()
    texts = texts_of(keyed, nodes)
    release(groups.sparkSession)
    hubs = durable(connecting_links(banded, keyed, shingle, percent, texts))
    release(groups.sparkSession)
    return hubs.union(_pair_links(pairs, hubs, texts, shingle, percent))


def _crowds(members: DataFrame, crowded: DataFrame, crowd: int) -> DataFrame:
    """``node, n, key``: the members of crowded tokens and of large groups, bucket by bucket."""
    by_token = crowded.select("group", F.col("token").alias("key"))
    expanded = members.select("group", "node", "n").join(by_token, "group").select("node", "n", "key")
    by_group = members.filter(F.col("m") > crowd).select("node", "n", F.col("group").alias("key"))
    return expanded.union(by_group)


def _member_pairs(near: DataFrame, members: DataFrame, crowd: int) -> DataFrame:
    """``a, b`` (a > b): the members of near groups, and of each small group among themselves."""
    inside = members.filter(F.col("m").between(2, crowd)).select("group", "node")
    across = near.join(members.select(F.col("group").alias("x"), F.col("node").alias("a")), "x").join(
        members.select(F.col("group").alias("y"), F.col("node").alias("b")), "y"
    )
    twins = inside.toDF("group", "a").join(inside.toDF("group", "b"), "group").filter("a > b")
    ordered = across.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ordered.union(twins.select("a", "b"))


def _group_pairs(shared: DataFrame, crowded: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """``x, y``: groups that can be similar by size and by the tokens their prefixes share.

    If the last token of x's prefix comes first, all that x and y share up to it lies in
    both prefixes, and x has ``n_x - p_x`` tokens behind it. Tokens that are not listed
    here because they are crowded count as shared. ``facts``: ``group, n, p``.
    """
    hidden = crowded.groupBy("group").agg(F.count("*").alias("hidden"))
    facts = stored(
        facts.join(hidden, "group", "left").select("group", "n", "p", F.coalesce("hidden", F.lit(0)).alias("hidden"))
    )
    side = shared.join(facts.select("group", "n"), "group")
    x, y = side.toDF("x", "token", "n_x"), side.toDF("y", "token", "n_y")
    ordered = F.struct("n_x", "x") > F.struct("n_y", "y")
    met = x.join(y, "token").filter(ordered & (100 * F.col("n_y") >= percent * F.col("n_x")))
    counts = met.groupBy("x", "y").agg(F.count("*").alias("c"))
    counts = counts.join(facts.toDF("x", "n_x", "p_x", "h_x"), "x").join(facts.toDF("y", "n_y", "p_y", "h_y"), "y")
    behind = F.greatest(F.col("n_x") - F.col("p_x"), F.col("n_y") - F.col("p_y"))
    most = F.col("c") + F.least("h_x", "h_y") + behind
    return counts.filter((100 + percent) * most >= percent * (F.col("n_x") + F.col("n_y"))).select("x", "y")


def _pair_links(pairs: DataFrame, hubs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links among ``pairs`` (a > b) that connect what they and ``hubs`` connect."""

    def apart(links: DataFrame) -> DataFrame:
        roots = durable(components(links))
        named = pairs.join(roots.toDF("a", "root_a"), "a", "left").join(roots.toDF("b", "root_b"), "b", "left")
        return named.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")

    lowest = durable(apart(hubs).groupBy("a").agg(F.min("b").alias("b")))
    links = durable(confirm(lowest, texts, shingle, percent))
    rest = apart(hubs.union(links)).join(lowest, ["a", "b"], "left_anti").distinct()
    return links.union(durable(confirm(rest, texts, shingle, percent)))
