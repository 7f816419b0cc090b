"""Missing links: choose among the mentions, show them, write them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.config import Config
from thicket.durable import durable
from thicket.functions import edits as batches
from thicket.functions import paths, text
from thicket.functions.grams import TitleNames, TitleOrder
from thicket.functions.once import computed
from thicket.functions.ranges import empty_spans, protected_ranges, span
from thicket.operators.choice import EDITS, chosen_texts, edited_texts, greedy
from thicket.operators.clutter import protection, unprotected_notes
from thicket.operators.links import link_target, link_tokens
from thicket.operators.mentions import exploded, found_texts, titles_among
from thicket.operators.metadata import with_metadata
from thicket.operators.targets import Dictionary, build_dictionary, link_targets, target_hash

_TEXT = ("_text", "_kept", "_names")


def suggest_links(
    notes: DataFrame, cfg: Config, targets: DataFrame | None = None
) -> DataFrame:
    """(path, target, matched_text, line, context, start, end, replacement).

    ``targets`` default to the titles and aliases of ``notes`` themselves.
    """
    return stored_suggestions(notes, cfg, targets)[0]


def stored_suggestions(
    notes: DataFrame, cfg: Config, targets: DataFrame | None = None
) -> tuple[DataFrame, bool]:
    """``suggest_links``, and whether its rows lie behind a shuffle, so that they may be read twice.

    Where every task can have the names of all targets, links are shown where the texts lie
    and then shuffled by path; texts are not.
    """
    targets = link_targets(notes, cfg) if targets is None else targets
    given, content, dictionary = _searched(notes.select("path", "content"), targets, cfg)
    tables = _named(dictionary)
    if tables:
        texts = _texts(given, content, cfg)
        shown = edited_texts(dictionary, tables, cfg.link_max_per_note, batches.SHOWN, batches.show)(*_TEXT)
        made = texts.select("path", shown.alias("_chosen")).select("path", computed(_chosen=F.col("_chosen")))
        placed = made.filter(F.size("_chosen") > 0).repartition("path")
        return placed.select("path", F.inline("_chosen")), True
    planned = _planned(given, content, dictionary, cfg)[1].filter(F.size("edits") > 0)
    shown = planned.select("path", _described(F.col("content"), F.col("edits")).alias("_shown"))
    return shown.select("path", F.inline("_shown")), False


def plan_edits(notes: DataFrame, targets: DataFrame, cfg: Config) -> DataFrame:
    """(path, content, edits): the links each note should get, in text order.

    Texts are searched for titles where they lie, and their links chosen there, then notes are
    hash-partitioned by path once, with what was chosen; titles are looked up for that alone.
    Where the order of titles is too large for every task, notes take along what was found,
    and it is chosen after the titles were looked up.
    """
    return _plan(notes.select("path", "content"), targets, cfg)[1].filter(F.size("edits") > 0)


def apply_links(
    notes: DataFrame,
    cfg: Config,
    accepted: DataFrame | None = None,
    targets: DataFrame | None = None,
) -> DataFrame:
    """(path, content, n_applied) of every changed note.

    The plan is made again on the current notes with all targets; then only the
    accepted (path, target) pairs are written. Without ``accepted``, all are.
    """
    given = notes.select("path", "content")
    targets = link_targets(notes, cfg) if targets is None else targets
    if accepted is not None:
        accepted = _accepted_pairs(accepted)
        given = given.join(accepted.select("path").distinct(), "path", "left_semi")
    given, content, dictionary = _searched(given, targets, cfg)
    tables = _named(dictionary)
    if tables and accepted is None:
        written = _written_in_place(given, content, dictionary, tables, cfg)
        changed = written.filter("_made.n_applied > 0")
        return changed.select("path", "_made.content", "_made.n_applied")
    if tables:
        edits = _edits_in_place(given, content, dictionary, tables, cfg)
        planned = given.select("path", "content").join(_kept(edits, accepted), "path")
    else:
        placed, planned = _planned(given, content, dictionary, cfg)
        if accepted is not None:
            planned = placed.join(_kept(planned, accepted), "path")
    return planned.filter(F.size("edits") > 0).select(
        "path", _linked(F.col("content"), F.col("edits")).alias("content"), _count(F.col("edits"))
    )


def linked_corpus(
    notes: DataFrame,
    cfg: Config,
    accepted: DataFrame | None = None,
    targets: DataFrame | None = None,
) -> DataFrame:
    """All notes with the accepted links written, and n_applied, 0 where there are none.

    The texts are shuffled once, so that the rows lie by path whichever way links were chosen.
    """
    targets = link_targets(notes, cfg) if targets is None else targets
    given, text, dictionary = _searched(notes, targets, cfg)
    tables = _named(dictionary)
    content, made = F.col("content"), F.col("edits")
    if tables and accepted is None:
        planned = _written_in_place(given, text, dictionary, tables, cfg)
        columns = {"content": F.coalesce("_made.content", "content")}
        count = F.coalesce("_made.n_applied", F.lit(0).cast("bigint")).alias("n_applied")
    else:
        if tables:
            edits = _edits_in_place(given, text, dictionary, tables, cfg)
            planned = given.select(*notes.columns).join(_kept(edits, _accepted_pairs(accepted)), "path", "left")
        else:
            placed, planned = _planned(given, text, dictionary, cfg)
            if accepted is not None:
                planned = placed.join(_kept(planned, _accepted_pairs(accepted)), "path", "left")
        columns = {"content": F.when(F.size(made) > 0, _linked(content, made)).otherwise(content)}
        count = _count(made)
    linked = planned.select(*(columns.get(c, F.col(c)).alias(c) for c in notes.columns), count)
    if tables and accepted is None:
        linked = linked.repartition("path")
    return linked.unionByName(
        notes.filter("path IS NULL").withColumn("n_applied", F.lit(0).cast("bigint"))
    )


def _accepted_pairs(accepted: DataFrame) -> DataFrame:
    # Often the result of a scan, and read several times here.
    path = paths.normalize_path(F.col("path")).alias("path")
    return durable(accepted.select(path, "target").distinct())


def _kept(planned: DataFrame, accepted: DataFrame) -> DataFrame:
    """(path, edits) with only the accepted edits. Accepted rows are matched one by
    one, never gathered, so a long or repetitive list of them does no harm."""
    return (
        planned.select("path", F.explode("edits").alias("edit"))
        .withColumn("target", F.col("edit.target"))
        .join(accepted, ["path", "target"], "left_semi")
        .groupBy("path")
        .agg(F.sort_array(F.collect_list("edit")).alias("edits"))
    )


def _plan(notes: DataFrame, targets: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """``notes`` (path, content and others), partitioned by path; and these with the ``edits`` of each.
    Rows without a path are left out."""
    return _planned(*_searched(notes, targets, cfg), cfg)


def _searched(notes: DataFrame, targets: DataFrame, cfg: Config) -> tuple[DataFrame, Column, Dictionary | None]:
    """``notes`` that have a path, which of their texts are searched, and the titles to search for."""
    # Joins leave such rows out as well. Only if they are apart from the start do all read the same shuffle.
    notes, content = notes.filter("path IS NOT NULL"), F.col("content")
    searched, given = notes, notes
    if cfg.respect_protection:
        searched, described = unprotected_notes(notes, cfg), with_metadata(notes)
        given = described.select(*notes.columns, protection(described, cfg).alias("_protected"))
        content = F.when(~F.col("_protected"), content)
    return given, content, build_dictionary(targets, cfg, searched)


def _planned(
    given: DataFrame, content: Column, dictionary: Dictionary | None, cfg: Config
) -> tuple[DataFrame, DataFrame]:
    """The results of ``_plan``, of those of ``_searched``."""
    others = [c for c in given.columns if c not in ("path", "_protected")]
    nothing = F.array().cast(EDITS)
    if dictionary is None:
        notes = given.select("path", *others)
        return notes, notes.select("*", nothing.alias("edits"))
    order = dictionary.title_order()
    if order is not None:
        return _chosen_in_place(given, content, dictionary, order, cfg)
    # All readers of this shuffle take all of its columns, or Spark would make it twice.
    placed = (
        given.select("path", *others, computed(_text=content))
        .select("path", *others, found_texts(F.col("_text"), dictionary).alias("_texts"))
        .repartition("path")
        .select("path", computed(**{c: F.col(c) for c in (*others, "_texts")}))
    )
    by_note = (
        titles_among(placed.select("path", exploded(F.col("_texts"))), dictionary)
        .groupBy("path")
        .agg(F.collect_list(F.struct("match_len", "width", "entries", "starts")).alias("_found"))
    )
    text_with_titles = F.when(F.col("_found").isNotNull(), F.col("content"))
    barred = computed(_kept=_off_limits(text_with_titles, cfg), _linked=_linked_already(text_with_titles, cfg))
    chosen = _choice(cfg)(F.col("_found"), F.col("_kept"), paths.base_name(F.col("path")), F.col("_linked"))
    planned = (
        placed.join(by_note, "path", "left")
        .select("path", *others, "_found", barred)
        .select("path", *others, chosen.alias("_edits"))
        .select("path", *others, computed(edits=F.coalesce("_edits", nothing)))
    )
    return placed.drop("_texts"), planned


def _named(dictionary: Dictionary | None) -> tuple[TitleOrder, TitleNames] | None:
    """The order and the names of titles, if every task can have both."""
    order, names = dictionary.named_order() if dictionary else (None, None)
    return (order, names) if names else None


def _edits_in_place(
    given: DataFrame, content: Column, dictionary: Dictionary, tables: tuple[TitleOrder, TitleNames], cfg: Config
) -> DataFrame:
    """(path, edits), chosen where the texts lie."""
    edits = edited_texts(dictionary, tables, cfg.link_max_per_note)(*_TEXT)
    return _texts(given, content, cfg).select("path", edits.alias("_edits")).select("path", computed(edits=F.col("_edits")))


def _written_in_place(
    given: DataFrame, content: Column, dictionary: Dictionary, tables: tuple[TitleOrder, TitleNames], cfg: Config
) -> DataFrame:
    """``given`` and ``_made``: (content, n_applied) with all links written where the texts lie, null and 0 without."""
    others = [c for c in given.columns if c not in ("path", "_protected")]
    made = edited_texts(dictionary, tables, cfg.link_max_per_note, batches.WRITTEN, batches.write)(*_TEXT)
    texts = _texts(given, content, cfg).select("path", *others, made.alias("_written"))
    return texts.select("path", *others, computed(_made=F.col("_written")))


def _texts(given: DataFrame, content: Column, cfg: Config) -> DataFrame:
    """``given`` and, in ``_TEXT``, what choosing links in a text takes."""
    others = [c for c in given.columns if c not in ("path", "_protected")]
    made = given.select("path", *others, computed(_text=F.make_valid_utf8(content), _own=paths.base_name(F.col("path"))))
    names = F.concat(F.array("_own"), F.coalesce(_linked_already(F.col("_text"), cfg), F.array().cast("array<string>")))
    barred = computed(
        _kept=F.coalesce(_off_limits(F.col("_text"), cfg), empty_spans()),
        _names=F.transform(names, target_hash),
    )
    return made.select("path", *others, "_text", barred)


def _chosen_in_place(
    given: DataFrame, content: Column, dictionary: Dictionary, order: TitleOrder, cfg: Config
) -> tuple[DataFrame, DataFrame]:
    """The results of ``_plan``, with links chosen where the texts lie."""
    others = [c for c in given.columns if c not in ("path", "_protected")]
    chosen = chosen_texts(dictionary, order, cfg.link_max_per_note)(*_TEXT)
    placed = (
        _texts(given, content, cfg)
        .select("path", *others, chosen.alias("_chosen"))
        .repartition("path")
        .select("path", computed(**{c: F.col(c) for c in (*others, "_chosen")}))
    )
    titles = dictionary.titles.select("key", "width", "entries")
    links = placed.select("path", F.inline("_chosen")).join(
        F.broadcast(titles) if dictionary.is_small else titles, "key"
    )
    edit = F.struct(
        "start",
        (F.col("start") + F.col("width")).cast("int").alias("end"),
        F.get("entries", F.col("number"))["target"].alias("target"),
    )
    by_note = links.select("path", edit.alias("edit")).groupBy("path").agg(F.sort_array(F.collect_list("edit")).alias("_edits"))
    planned = placed.join(by_note, "path", "left").select(
        "path", *others, computed(edits=F.coalesce("_edits", F.array().cast(EDITS)))
    )
    return placed.drop("_chosen"), planned


def _choice(cfg: Config) -> Callable[..., Column]:
    cap = cfg.link_max_per_note
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("target", pa.string())]))

    @F.arrow_udf(EDITS)
    def chosen(found: pa.Array, kept: pa.Array, own_name: pa.Array, linked: pa.Array) -> pa.Array:
        return pa.array(_choose_all(found, kept, own_name, linked, cap), kind)

    return chosen


def _choose_all(found: pa.Array, kept: pa.Array, own_name: pa.Array, linked: pa.Array, cap: int) -> Iterator[list[dict]]:
    """``free_choice`` of each row, from whole columns: nested values taken one by one cost far more."""
    titles, spans, names = found.values, kept.values, own_name.to_pylist()
    of_note, of_spans, of_links = (column.offsets.to_pylist() for column in (found, kept, linked))
    entries, starts = titles.field("entries"), titles.field("starts")
    of_title, of_starts = entries.offsets.to_pylist(), starts.offsets.to_pylist()
    widths, orders = _plain(titles.field("width")), (-titles.field("match_len").to_numpy(zero_copy_only=False)).tolist()
    places, linked_names = _plain(starts.values), _plain(linked.values)
    paths_, ords, targets = (
        _plain(entries.values.field(name)) for name in ("path", "ord", "target")
    )
    span_starts, span_ends = _plain(spans.field("start")), _plain(spans.field("end"))
    for row, name in enumerate(names):
        numbers = range(of_note[row], of_note[row + 1])
        choices = [
            (orders[i], paths_[e].encode(), ords[e], targets[e], i - of_note[row])
            for i in numbers
            for e in range(of_title[i], of_title[i + 1])
        ]
        held = [(widths[i], places[of_starts[i] : of_starts[i + 1]]) for i in numbers]
        barred = range(of_spans[row], of_spans[row + 1])
        yield _edits(
            held,
            choices,
            [(span_starts[k], span_ends[k]) for k in barred],
            {name, *linked_names[of_links[row] : of_links[row + 1]]},
            cap,
        )


def _plain(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


def free_choice(found: list[dict], kept: list[dict], own_name: str, linked: list[str], cap: int = 0) -> list[dict]:
    """The links of one note, in text order; at most ``cap``, if that is not 0.

    Titles are taken longest first, then by the path of their note. Each gets its first
    mention that is neither covered nor taken; a mention that the one before it
    overlaps is passed over, as a search would have moved past it. A place that is
    taken stays taken, so each title's mentions are looked at once.
    """
    choices = [
        (-title["match_len"], entry["path"].encode(), entry["ord"], entry["target"], i)
        for i, title in enumerate(found)
        for entry in title["entries"]
    ]
    titles = [(title["width"], title["starts"]) for title in found]
    return _edits(titles, choices, [(span["start"], span["end"]) for span in kept], {own_name, *linked}, cap)


def _edits(
    titles: list[tuple[int, list[int]]],
    choices: list[tuple[int, bytes, int, str, int]],
    kept: list[tuple[int, int]],
    done: set[str],
    cap: int,
) -> list[dict]:
    """``titles`` are (width, starts), ``choices`` end with target and number of a title."""
    if not choices:
        return []
    size = max(starts[-1] + width for width, starts in titles)
    ordered = ((target, target, i) for *_, target, i in sorted(choices))
    taken = greedy(lambda i: titles[i], ordered, size, kept, done, cap)
    return [{"start": start, "end": start + width, "target": target} for start, width, target in taken]


def _described(content: Column, edits: Column) -> Column:
    """Each edit with what a reviewer sees of it."""
    return batches.described(F.make_valid_utf8(content), edits)


def _linked(content: Column, edits: Column) -> Column:
    """The text with its edits written."""
    return batches.linked(F.make_valid_utf8(content), edits)


def _count(edits: Column) -> Column:
    return F.coalesce(F.size(edits), F.lit(0)).cast("bigint").alias("n_applied")


def _off_limits(content: Column, cfg: Config) -> Column:
    """Ranges that must not be edited."""
    ranges = protected_ranges(content)
    if not cfg.protect_frontmatter:
        return ranges
    size = F.length(text.frontmatter(content))
    whole = F.when(size > 0, F.array(span(F.lit(0), size))).otherwise(empty_spans())
    return F.sort_array(F.concat(whole, ranges))


def _linked_already(content: Column, cfg: Config) -> Column:
    """Names of the notes that the text links to, where those are to be passed over."""
    if not cfg.skip_already_linked:
        return F.array().cast("array<string>")
    return F.array_distinct(F.transform(link_tokens(content), lambda t: paths.note_name(link_target(t))))

