"""Near-duplicate documents by circulant MinHash, banding and exact confirmation.

Two permutations make a whole signature. The first, a hash, sends each shingle
to a place on a circle of 2^32 places. The second gives each place a rank, and
coordinate k is the smallest rank of a document's places after the circle is
shifted by k. ``BANDS`` bands of ``ROWS`` coordinates miss a pair of similarity
0.8 once in eight million. Every proposed pair is confirmed on full shingle sets.

Copies never pair up. Documents of equal word sequences are one class, and only
its representative goes on. In each bucket the member that shares the most
buckets is compared with all others, then another among those that it is not
connected with: a number of pairs linear in the size of the bucket. Links that
this leaves out are between members that share a change against the first of the
two, and are found by a join on such changes (see ``_pairs_that_share_changes``),
so no link between different texts that a bucket holds is lost.

Scale: texts are read twice, once for signatures and once for those that share a
bucket. Everything else works on row numbers. Buckets are counted before they
are joined, and every join has an even side, so adaptive execution can cut the
partitions of hot buckets.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.durable import durable, release, stored
from thicket.llm.components import components
from thicket.llm.rows import ROW, with_row_ids
from thicket.llm.shingles import Shingler, mixed, portions, words_of

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 40, 5
_BASE = 0x9E3779B97F4A7C15 | 1
_U64 = np.uint64


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``_thicket_row, doc_id, n_shingles, component_id, kept``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document's set is its
    distinct shingles of ``shingle`` words, or its whole sequence if it has fewer.
    Documents with ``100 * common >= percent * all`` are linked. ``component_id`` is
    the smallest ``doc_id`` reachable (null ids count as largest) and the row that
    has it is kept; of rows that repeat it, one. Null texts and texts without words
    have no shingles and no links. Other columns are ignored; an empty table gives
    no rows.
    """
    keyed = with_row_ids(docs, "doc_id", "text")
    sketched = stored(sketches(keyed, shingle))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    classes = durable(
        sketched.filter("n_shingles > 0").groupBy("same").agg(F.min(order).alias("m")).select(
            "same", F.col(f"m.{ROW}").alias("node")
        )
    )
    nodes = sketched.join(classes.select(F.col("node").alias(ROW)), ROW)
    banded = nodes.select(F.col(ROW).alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    roots = components(connecting_links(banded, keyed, shingle, percent))
    return by_component(sketched, classes, roots)


def by_component(sketched: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Every row with the smallest ``doc_id`` of its component; see ``near_duplicates``.

    ``sketched`` names the class of each row in ``same``, ``classes`` the ``node`` of each class, and
    ``roots`` the ``root`` of each node that has a link.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    placed = sketched.select(ROW, "doc_id", "n_shingles", "same").join(classes, "same", "left").join(
        roots, "node", "left"
    )
    group = F.coalesce("root", "node", F.col(ROW))
    placed = durable(placed.select(ROW, "doc_id", "n_shingles", group.alias("group")))
    first = placed.groupBy("group").agg(F.min(order).alias("m")).select(
        "group", F.col("m.doc_id").alias("component_id"), F.col(f"m.{ROW}").alias("keep")
    )
    # Written first: Spark splits a hot group only where both sides come from a shuffle as they are.
    return placed.join(durable(first), "group").select(
        ROW, "doc_id", "n_shingles", "component_id", (F.col("keep") == F.col(ROW)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component.

    Rows without words are near nothing and stay; of rows that are the same, one stays; an
    empty table gives no rows. All columns stay.
    """
    keyed = with_row_ids(docs)
    kept = near_duplicates(keyed).filter("kept")
    return keyed.join(kept.select(ROW), ROW, "left_semi").select(*docs.columns)


def connecting_links(
    banded: DataFrame, keyed: DataFrame, shingle: int, percent: int, texts: DataFrame | None = None
) -> DataFrame:
    """``a, b``: links, confirmed on full sets, that connect all nodes which any links
    between nodes of one bucket connect.

    ``banded`` has ``node``, ``n`` (the size of its set) and ``key``, a bucket; ``keyed`` the
    texts of the nodes by ``_thicket_row``, from which ``texts`` (``node, text``) are taken if
    not given.
    """
    buckets = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    crowded = stored(banded.join(buckets, "key"))
    scores = crowded.groupBy("node", "n").agg(F.sum("size").alias("score"))
    members = stored(crowded.drop("n", "size").join(scores, "node"))
    texts = texts_of(keyed, scores) if texts is None else texts

    def labelled(links: DataFrame, rows: DataFrame) -> DataFrame:
        roots = components(links)
        return durable(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))

    # The member that shares the most buckets is compared with all others of a bucket.
    led = members.join(_leaders(members, "key"), "key")
    groups = durable(led.select("lead", "node", "n").distinct())
    first = groups.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    links = durable(confirm(first, texts, shingle, percent))
    release(banded.sparkSession)
    # The same once more among those that are not in its component.
    state = labelled(links, led)
    heads = _heads(state, "lead")
    strays = state.join(heads, "lead").filter("root <> lead_root").select("key", "node", "score", "root")
    next_ = strays.join(_leaders(strays, "key"), "key").filter("node <> lead")
    second = durable(next_.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    links = durable(links.union(confirm(second, texts, shingle, percent)))
    release(banded.sparkSession)
    rest = _pairs_that_share_changes(labelled(links, groups), texts, shingle, percent)
    rest = rest.join(_ordered(first.union(second)), ["a", "b"], "left_anti")
    return links.union(durable(confirm(rest, texts, shingle, percent)))


def texts_of(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of the given nodes, stored."""
    wanted = nodes.select(F.col("node").alias(ROW))
    return stored(keyed.join(wanted, ROW, "left_semi").select(F.col(ROW).alias("node"), "text"))


def _leaders(members: DataFrame, group: str) -> DataFrame:
    best = F.max(F.struct("score", -F.col("node")))
    return members.groupBy(group).agg(best.alias("m")).select(group, (-F.col("m.col2")).alias("lead"))


def _heads(state: DataFrame, lead: str) -> DataFrame:
    """The component of each leader; one that has no link is its own."""
    roots = state.select(F.col("node").alias(lead), F.col("root").alias("lead_root")).distinct()
    leads = state.select(lead).distinct()
    return leads.join(roots, lead, "left").withColumn("lead_root", F.coalesce("lead_root", lead))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _pairs_that_share_changes(groups: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``a, b``: the pairs of a group that may be linked though their leader links them not.

    ``groups`` has the leaders as rows of their own groups too, so that each has its root.

    A member's changes are the shingles by which it differs from the leader. With
    d(x), d(y) changes of which c are the same, the sets differ in d(x) + d(y) - 2c
    shingles, and a link allows at most a share of their sizes. For a member that
    the leader is not linked with this means c > 0: it must share a change with the
    other. At most so many of its changes may be its own, so one of a few, the
    rarest that others have at all, is shared. Members are joined on these, and only
    where the bound can hold. The work thus follows what members have in common
    beyond their leader, not the square of the group.
    """
    placed = groups.join(_heads(groups, "lead"), "lead").filter("node <> lead")
    placed = placed.withColumn("stray", F.col("root") != F.col("lead_root"))
    open_ = (
        placed.groupBy("lead")
        .agg(F.count("*").alias("all"), F.max("stray").alias("any"))
        .filter("any AND all > 1")
        .select("lead")
    )
    placed = durable(placed.join(open_, "lead").select("lead", "node", "n", "root", "stray"))
    pairs = placed.select(F.col("lead").alias("a"), F.col("node").alias("b"))
    changes = stored(_with_texts(pairs, texts).mapInArrow(_changes(shingle), "lead bigint, node bigint, changes array<bigint>"))
    each = changes.select("lead", "node", F.explode("changes").alias("change"))
    counts = each.groupBy("lead", "change").agg(F.count("*").alias("times")).filter("times > 1")
    shared = each.join(counts, ["lead", "change"])
    lists = (
        shared.groupBy("lead", "node")
        .agg(F.sort_array(F.collect_list(F.struct("times", "change"))).alias("shared"))
        .join(changes.select("lead", "node", F.size("changes").alias("d")), ["lead", "node"])
        .join(placed, ["lead", "node"])
        .withColumn("c", F.size("shared"))
    )
    lists = durable(lists)
    # A link allows sets of sizes x and y to differ in allowed * (x + y) shingles, and y <= 100 x / percent.
    most = (100 - percent) * (100 + percent) * F.col("n")
    own = F.floor(most / (percent * (100 + percent)) - (F.col("d") - F.col("c")))
    left = (
        lists.filter("stray")
        .withColumn("own", own)
        .filter("own >= 0")
        .select(
            "lead",
            F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("root").alias("root_x"),
            F.col("d").alias("d_x"), F.col("c").alias("c_x"),
            F.posexplode(F.slice("shared", F.lit(1), (F.col("own") + 1).cast("int"))).alias("k", "s"),
        )
        .withColumn("change", F.col("s.change"))
        .drop("s")
    )
    right = lists.select(
        "lead",
        F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("root").alias("root_y"),
        F.col("d").alias("d_y"), F.col("c").alias("c_y"),
        F.explode("shared.change").alias("change"),
    )
    # At the first change that both have, the k before it are not shared.
    least = F.col("d_x") + F.col("d_y") - 2 * F.least(F.col("c_x") - F.col("k"), F.col("c_y"))
    fits = (
        (F.col("root_x") != F.col("root_y"))
        & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
        & ((100 + percent) * least <= (100 - percent) * (F.col("n_x") + F.col("n_y")))
    )
    same = [left["lead"] == right["lead"], left["change"] == right["change"]]
    found = left.join(right, [*same, fits]).select(left["lead"], "x", "y").distinct()
    facts = lists.select("lead", "node", "n", "d", "shared.change")
    found = found.join(facts.toDF("lead", "x", "n_x", "d_x", "s_x"), ["lead", "x"])
    found = found.join(facts.toDF("lead", "y", "n_y", "d_y", "s_y"), ["lead", "y"])
    differ = F.col("d_x") + F.col("d_y") - 2 * F.size(F.array_intersect("s_x", "s_y"))
    linked = (100 + percent) * differ <= (100 - percent) * (F.col("n_x") + F.col("n_y"))
    return _ordered(found.filter(linked).select(F.col("x").alias("a"), F.col("y").alias("b")))


def _changes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(width)
        for batch in batches:
            out = []
            for left, right in sets.of(batch):
                digests = (hashlib.blake2b(s, digest_size=8).digest() for s in left ^ right)
                out.append([int.from_bytes(d, "big", signed=True) for d in digests])
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(out, pa.list_(pa.int64()))], ["lead", "node", "changes"]
            )

    return run


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The ``pairs`` (``a, b``) whose full shingle sets are similar enough. ``texts``: ``node, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(shingle)
        for batch in batches:
            keep = []
            for left, right in sets.of(batch):
                common = len(left & right)
                keep.append(100 * common >= percent * (len(left) + len(right) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_texts(pairs, texts).mapInArrow(run, "a bigint, b bigint")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    whole = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return whole.select("a", "b", "text_a", "text_b")


class _Sets:
    """Shingle sets of the pairs of a batch; the last ones used are kept."""

    def __init__(self, width: int, most: int = 200_000):
        self.width, self.most, self.size = width, most, 0
        self.known: OrderedDict[int, set[bytes]] = OrderedDict()

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple[set[bytes], set[bytes]]]:
        for a, b, text_a, text_b in zip(*(batch.column(c) for c in ("a", "b", "text_a", "text_b"))):
            yield self._one(a.as_py(), text_a), self._one(b.as_py(), text_b)

    def _one(self, node: int, text: pa.Scalar) -> set[bytes]:
        if node in self.known:
            self.known.move_to_end(node)
            return self.known[node]
        found = shingles(text.as_py() or "", self.width)
        while self.known and self.size + len(found) > self.most:
            self.size -= len(self.known.popitem(last=False)[1])
        self.known[node] = found
        self.size += len(found)
        return found


def shingles(text: str, width: int) -> set[bytes]:
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def sketches(keyed: DataFrame, width: int) -> DataFrame:
    """``_thicket_row, doc_id, n_shingles, same, bands``: set size, digest of the words, band keys."""
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for part in portions(batch):
                sizes, same, bands = sketch([words_of(t.as_py() or "") for t in part.column("text")], shingler)
                keys = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(
                    pa.list_(pa.int64())
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(ROW), part.column("doc_id"), pa.array(sizes), pa.array(same, pa.binary()), keys],
                    [ROW, "doc_id", "n_shingles", "same", "bands"],
                )

    return keyed.select(ROW, "doc_id", "text").mapInArrow(
        run, f"{ROW} bigint, doc_id {kind}, n_shingles bigint, same binary, bands array<bigint>"
    )


def sketch(texts: list[list[bytes]], shingler: Shingler) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Set sizes, digests of the word sequences, and band keys of some texts."""
    same = [hashlib.blake2b(b" ".join(words), digest_size=16).digest() for words in texts]
    sizes, sets = zip(*(shingler.tokens(words) for words in texts))
    sizes, held = np.array(sizes, np.int64), np.array([len(s) for s in sets], np.int64)
    bands = np.zeros((len(texts), BANDS), np.int64)
    full = sizes > 0
    if full.any():
        places = (np.concatenate(sets) >> _U64(32)).astype(np.uint32)
        starts = np.cumsum(held[full]) - held[full]
        bands[full] = _band_keys(places, starts)
    return sizes, same, bands


def _band_keys(places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    keys = np.empty((len(starts), BANDS), np.uint64)
    rank, high = np.empty_like(places), np.empty_like(places)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64)
        for row in range(ROWS):
            # The second permutation: odd factors and shifts are bijections of 32 bits.
            np.add(places, np.uint32(band * ROWS + row), out=rank)
            rank *= np.uint32(0x7FEB352D)
            np.right_shift(rank, np.uint32(15), out=high)
            rank ^= high
            rank *= np.uint32(0x846CA68B)
            np.right_shift(rank, np.uint32(16), out=high)
            rank ^= high
            key = mixed(key * _U64(_BASE) + np.minimum.reduceat(rank, starts))
        keys[:, band] = key
    return keys.view(np.int64)
