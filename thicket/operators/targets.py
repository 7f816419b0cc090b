"""The dictionary of linkable titles and aliases."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.config import Config
from thicket.durable import durable
from thicket.functions import paths, text
from thicket.functions.grams import TitleFilter, TitleNames, TitleOrder, character_tables, filter_bits, text_hash
from thicket.operators.metadata import with_metadata
from thicket.operators.ranking import shuffled_once

# Array and row headers of one broadcast dictionary row and one of its entries.
_ROW_BYTES, _ENTRY_BYTES = 96, 64
_LIMIT_BEFORE_SHUFFLE = "spark.sql.optimizer.windowGroupLimitThreshold"
_SALTS = 64
# The lead filter has at most this many rows, whatever the dictionary's size.
_LEAD_BUCKETS = 1 << 20
# Words of 64 bits in the filter of whole titles, at least, and how many titles share one.
_FILTER_WORDS, _TITLES_PER_WORD = 1 << 12, 4
_FILTER_ROW_BYTES = 32
# What ``TitleOrder`` takes of a title and of one of its entries, and ``TitleNames`` besides the texts.
_ORDER_TITLE_BYTES, _ORDER_ENTRY_BYTES = 12, 16
_NAME_BYTES = 4


def link_targets(notes: DataFrame, cfg: Config) -> DataFrame:
    """(match, target, path, ord, match_len): titles (ord 0) and aliases (1, 2, ...)."""
    path = F.col("path")
    title = paths.base_name(path)
    if cfg.link_use_aliases:
        described = with_metadata(notes)
        aliases = F.transform(
            F.coalesce("aliases", F.array().cast("array<string>")), text.js_trim
        )
        names = F.concat(F.array(title), aliases)
    else:
        described, names = notes, F.array(title)
    return (
        described.select("path", F.posexplode(names).alias("ord", "match"))
        .select(
            "match",
            paths.base_name(path).alias("target"),
            "path",
            "ord",
            text.utf16_length(F.col("match")).cast("int").alias("match_len"),
        )
        .filter(F.col("match_len") >= cfg.link_min_title_length)
    )


@dataclass(frozen=True)
class Dictionary:
    """Titles keyed by the text that mentions them, and what is known of them.

    ``titles`` has (id, key, units, width, match_len, entries); ``units`` is the
    number of text units in the key and ``entries`` lists the (path, ord, target)
    it can stand for, best first.
    """

    titles: DataFrame
    cfg: Config
    shortest: int
    longest: int
    widest: int
    sizes: int
    bytes: int
    count: int
    entries: int
    name_bytes: int

    @property
    def is_small(self) -> bool:
        """Whether the titles may be broadcast."""
        return self.bytes <= self.cfg.broadcast_limit_bytes

    def title_filter(self, whole: bool) -> TitleFilter:
        """What tasks need to know of the titles, gathered in tables of bounded size.

        Hashing into a fixed number of buckets bounds the table of beginnings, so every task can
        have it even when the titles themselves cannot be broadcast.
        """
        buckets = self.lead_buckets()
        lead = gram(F.col("unit_list"), F.lit(0), F.lit(self.shortest), self.cfg)
        bucket = text_hash(lead).bitwiseAND(F.lit(buckets - 1)).alias("bucket")
        leads = self.titles.select(bucket, "units").distinct().toArrow().sort_by("bucket")
        counts = np.bincount(leads["bucket"].to_numpy(), minlength=buckets)
        word_chars, folded = character_tables(self.titles.sparkSession)
        return TitleFilter(
            self.shortest,
            self.widest,
            np.concatenate(([0], np.cumsum(counts))).astype(np.int32),
            leads["units"].to_numpy().astype(np.int32),
            self._whole_filter() if whole else None,
            word_chars if self.cfg.link_whole_word else None,
            None if self.cfg.link_case_sensitive else folded,
        )

    def title_order(self) -> TitleOrder | None:
        """The order in which titles are taken: longest first, then by the path of their note.

        None where it would exceed the broadcast limit, or two titles or two targets share a hash.
        """
        return self._ordered(False)[0]

    def named_order(self) -> tuple[TitleOrder | None, TitleNames | None]:
        """``title_order``, and the texts of titles and targets unless those would exceed the broadcast limit."""
        return self._ordered(self.name_bytes + _NAME_BYTES * (self.count + self.entries) <= self.cfg.broadcast_limit_bytes)

    def _ordered(self, named: bool) -> tuple[TitleOrder | None, TitleNames | None]:
        if self.count * _ORDER_TITLE_BYTES + self.entries * _ORDER_ENTRY_BYTES > self.cfg.broadcast_limit_bytes:
            return None, None
        listed = self.titles.select(
            text_hash("key").alias("hashed"), "key", "match_len", F.posexplode("entries").alias("number", "entry")
        ).select("hashed", "key", "match_len", "number", "entry.path", "entry.ord", "entry.target")
        # Of a title its first entry alone carries the key.
        written = F.when(F.col("number") == 0, _unlike(F.col("key"), F.col("target"))).alias("written")
        names = [written, F.col("target").alias("name")] if named else []
        distinct = listed.select("target").distinct().agg(F.count("*"), F.count_distinct(target_hash(F.col("target"))))
        if len(set(distinct.first())) > 1:
            return None, None
        # Behind a shuffle, as a sort reads its input twice.
        by_rank = (
            shuffled_once(listed, F.col("hashed"), F.col("number"))
            .orderBy(F.desc("match_len"), "path", "ord", "target", "key")
            .select("hashed", "number", target_hash(F.col("target")).alias("target"), *names)
            .toArrow()
        )
        hashed = by_rank["hashed"].to_numpy().view(np.uint64)
        ranks = np.lexsort((by_rank["number"].to_numpy(), hashed)) if named else np.argsort(hashed, kind="stable")
        numbers, targets = by_rank["number"].to_numpy()[ranks], by_rank["target"].to_numpy()[ranks]
        hashes, first = np.unique(hashed[ranks], return_index=True)
        if len(hashes) < self.count:
            return None, None
        offsets = np.append(first, len(ranks)).astype(np.int32)
        order = TitleOrder(hashes, offsets, ranks.astype(np.int32), numbers.astype(np.int32), targets)
        if not named:
            return order, None
        keys, held = (by_rank[c].combine_chunks() for c in ("written", "name"))
        return order, TitleNames(keys.take(pa.array(ranks[first])), held.take(pa.array(ranks)))

    def lead_buckets(self) -> int:
        buckets = _LEAD_BUCKETS
        limit = self.cfg.broadcast_limit_bytes
        while buckets > 1024 and buckets * (_ROW_BYTES + 8 * self.sizes) > limit:
            buckets //= 2
        return buckets

    def _whole_filter(self) -> np.ndarray:
        """A Bloom filter of whole titles, in words of 64 bits.

        A title sets three bits of one word, so a text is tested with one word. The
        number of words follows the number of titles up to the broadcast limit.
        """
        words, hashed = self.filter_words(), F.col("hashed")
        masks = (
            self.titles.select(text_hash("key").alias("hashed"))
            .groupBy(hashed.bitwiseAND(F.lit(words - 1)).alias("word"))
            .agg(F.bit_or(filter_bits(hashed)).alias("mask"))
            .toArrow()
        )
        table = np.zeros(words, np.int64)
        table[masks["word"].to_numpy()] = masks["mask"].to_numpy()
        return table.view(np.uint64)

    def filter_words(self) -> int:
        words, limit = _FILTER_WORDS, self.cfg.broadcast_limit_bytes // _FILTER_ROW_BYTES
        while words * _TITLES_PER_WORD < self.count and 2 * words <= limit:
            words *= 2
        return words


def _unlike(key: Column, target: Column) -> Column:
    """``key`` unless it is ``target``, of ASCII alone, in lower case."""
    return F.when((F.octet_length(target) != F.length(target)) | (F.lower(target) != key), key)


def target_hash(target: Column) -> Column:
    """What stands for a target's name in ``TitleOrder``."""
    return F.xxhash64(target)


def text_units(content: Column, cfg: Config) -> Column:
    """Split a text into the units a mention is made of.

    Whole-word rule: a unit is a run of word characters and the one character
    after it, so a mention starts where a unit starts and ends one character
    before a unit ends. The line break put at the end closes the last unit.
    Otherwise a unit is a single character.
    """
    folded = content if cfg.link_case_sensitive else text.fold_case(content)
    if not cfg.link_whole_word:
        return F.split(folded, "")
    unit_end = rf"(?<=[^{text.WORD_CHAR}])(?!\z)"
    return F.split(F.concat(folded, F.lit("\n")), unit_end)


def gram(units: Column, at: Column, size: Column, cfg: Config) -> Column:
    """``size`` units from position ``at``, written as a title would be.

    Declared non-null, or the optimizer would build each one twice to test it.
    """
    joined = F.array_join(F.slice(units, at + 1, size), "")
    if cfg.link_whole_word:
        joined = F.substring(joined, F.lit(1), F.length(joined) - 1)
    return F.coalesce(joined, F.lit(""))


def build_dictionary(targets: DataFrame, cfg: Config, notes: DataFrame) -> Dictionary | None:
    """Group targets by the (case-folded) text that mentions them, for use on ``notes``.

    The minimum length holds for supplied targets too.

    Many notes can share a title or alias. One note can use at most ``cap + 1``
    of them: each either becomes a link, is linked already through another text
    (both count towards the cap), or is the note's own name. So the first
    ``cap + 1`` are the whole answer. Without a cap, a note has no more links than
    mentions, and the longest note here bounds those (two UTF-16 units are one
    character at most).
    """
    units = text.utf16_length(F.col("match")).cast("int")
    targets = targets.withColumn("match_len", units).filter(
        F.col("match_len") >= cfg.link_min_title_length
    )
    most = cfg.link_max_per_note
    if not most:
        longest = notes.agg(F.max(F.length("content"))).first()[0] or 0
        most = 2 * longest // cfg.link_min_title_length + 1
    key = F.col("match") if cfg.link_case_sensitive else text.fold_case(F.col("match"))
    one_per_target = (
        targets.select(key.alias("key"), "target", "path", "ord", "match_len")
        .groupBy("key", "target")
        .agg(
            F.min(F.struct("path", "ord")).alias("first"),
            F.min("match_len").alias("match_len"),
        )
    )
    titles = (
        _first_of_each_key(one_per_target, most + 1)
        .groupBy("key")
        .agg(
            F.min("match_len").alias("match_len"),
            F.array_sort(
                F.collect_list(F.struct("first.path", "first.ord", "target"))
            ).alias("entries"),
        )
        .withColumn("unit_list", text_units(F.col("key"), cfg.exact_case()))
        .withColumn("units", F.size("unit_list"))
        .withColumn("width", F.length("key"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    titles = durable(titles)
    entry_bytes = F.aggregate(
        "entries",
        F.lit(0).cast("bigint"),
        lambda total, e: total
        + F.octet_length(e["path"])
        + F.octet_length(e["target"])
        + _ENTRY_BYTES,
    )
    first = F.get("entries", F.lit(0))["target"]
    name_bytes = F.aggregate(
        "entries", F.lit(0).cast("bigint"), lambda total, e: total + F.octet_length(e["target"])
    ) + F.coalesce(F.octet_length(_unlike(F.col("key"), first)), F.lit(0))
    found = titles.agg(
        F.min("units").alias("shortest"),
        F.max("units").alias("longest"),
        F.max("width").alias("widest"),
        F.count_distinct("units").alias("sizes"),
        F.sum(F.octet_length("key") + entry_bytes + _ROW_BYTES).alias("bytes"),
        F.count("*").alias("count"),
        F.sum(F.size("entries")).alias("entries"),
        F.sum(name_bytes).alias("name_bytes"),
    ).first()
    if found["bytes"] is None:
        return None
    return Dictionary(titles, cfg, **found.asDict())


def _first_of_each_key(rows: DataFrame, count: int) -> DataFrame:
    """The first ``count`` rows of each key in path order.

    Spark cuts counts below a setting before it shuffles. For larger ones the rows
    of a key are first spread over salts and cut there, so that no task sorts all
    notes that share one title.
    """
    if count > int(rows.sparkSession.conf.get(_LIMIT_BEFORE_SHUFFLE, "-1")):
        salt = F.xxhash64("target").bitwiseAND(F.lit(_SALTS - 1))
        rows = _first_rows(rows.withColumn("salt", salt), ["key", "salt"], count)
    return _first_rows(rows, ["key"], count)


def _first_rows(rows: DataFrame, group: list[str], count: int) -> DataFrame:
    best_first = Window.partitionBy(*group).orderBy("first.path", "first.ord")
    placed = rows.withColumn("place", F.row_number().over(best_first))
    return placed.filter(F.col("place") <= count).drop("place")
