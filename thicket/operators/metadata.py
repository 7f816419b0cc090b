"""Tags and aliases of a note, read from its text when no column supplies them.

Only flat metadata is read: ``key: [a, b]``, ``key: a`` or a list of ``- a``
lines. A caller with richer metadata supplies the columns instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions import text
from thicket.functions.once import evaluate_once


def with_metadata(notes: DataFrame) -> DataFrame:
    """Add ``inline_tags``, ``fm_tags`` and ``aliases`` where they are missing."""
    content = F.col("content")
    derived = {
        "inline_tags": inline_tags(content),
        "fm_tags": frontmatter_tags(content),
        "aliases": frontmatter_aliases(content),
    }
    missing = {k: v for k, v in derived.items() if k not in notes.columns}
    return notes.withColumns(missing) if missing else notes


def inline_tags(content: Column) -> Column:
    tag = rf"(?:\A|[{text.SPACE}])(#[{text.WORD_CHAR}/-]+)"

    def in_prose(body: Column) -> Column:
        found = F.regexp_extract_all(text.without_code(body), F.lit(tag), F.lit(1))
        return F.filter(found, lambda t: F.rlike(t, F.lit("[^#0-9]")))

    tags = evaluate_once(text.strip_frontmatter(content), in_prose)
    return F.when(F.contains(content, F.lit("#")), tags).otherwise(_no_strings())


def frontmatter_tags(content: Column) -> Column:
    """A list as it is, a text split at commas and spaces."""
    separator = rf"[,{text.SPACE}]+"
    return _listed(
        content,
        "tags",
        lambda scalar: F.filter(F.split(scalar, separator), lambda t: t != F.lit("")),
    )


def frontmatter_aliases(content: Column) -> Column:
    """A list as it is, a text as one alias."""
    return _listed(
        content,
        "aliases",
        lambda scalar: F.filter(F.array(scalar), lambda a: a != F.lit("")),
    )


def note_tags(notes: DataFrame) -> Column:
    """All tags of a note as they are compared: '#' off, lower case, distinct."""
    every = F.concat(
        F.coalesce(F.col("inline_tags"), _no_strings()),
        F.coalesce(F.col("fm_tags"), _no_strings()),
    )
    return F.array_distinct(F.transform(every, text.normalize_tag))


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _listed(content: Column, key: str, of_scalar: Callable[[Column], Column]) -> Column:
    """The values of a metadata key, in flow form, block form or as one scalar."""

    def values(meta: Column) -> Column:
        flow = F.regexp_extract(meta, rf"(?m)^{key}:[ \t]*\[([^\]]*)\]", 1)
        flow_items = F.regexp_extract_all(
            flow, F.lit(r"""\s*("[^"]*"|'[^']*'|[^,]+)"""), F.lit(1)
        )

        def chosen(block_items: Column) -> Column:
            items = F.when(flow != "", flow_items).otherwise(block_items)
            listed = F.transform(items, lambda item: _unquoted(F.trim(item)))
            return F.when((flow != "") | (F.size(block_items) > 0), listed).otherwise(
                evaluate_once(_scalar(meta, key), of_scalar)
            )

        return F.when(~F.contains(meta, F.lit(key + ":")), _no_strings()).otherwise(
            evaluate_once(_block_items(meta, key), chosen)
        )

    block = evaluate_once(text.frontmatter(content), values)
    return F.when(F.startswith(content, F.lit("---")), block).otherwise(_no_strings())


def _block_items(meta: Column, key: str) -> Column:
    """The ``- a`` lines right below the key, each without its dash.

    The block is cut into lines and the first other line looked for. A pattern
    that repeats a group of one line would recurse once per line in Java.
    """
    item = r"\A[ \t]*- (.*?)\r?\z"
    below = F.get(F.split(meta, rf"(?m)^{key}:[ \t]*\r?\n(?=[ \t]*- )", 2), F.lit(1))

    def run(lines: Column) -> Column:
        ends = F.array_position(F.transform(lines, lambda line: F.rlike(line, F.lit(item))), False)
        return F.slice(lines, F.lit(1), F.greatest(ends - 1, F.lit(0)).cast("int"))

    # What follows the last line break is no line; an empty end stops every run.
    lines = F.concat(F.slice(F.split(below, "\n"), 1, F.size(F.split(below, "\n")) - 1), F.array(F.lit("")))
    found = evaluate_once(lines, run)
    return F.coalesce(F.transform(found, lambda line: F.regexp_extract(line, item, 1)), _no_strings())


def _scalar(meta: Column, key: str) -> Column:
    """A single text value; numbers, booleans and nulls are no text."""
    value = F.trim(F.regexp_extract(meta, rf"(?m)^{key}:[ \t]+([^\[\r\n].*?)\r?$", 1))
    not_text = r"\A(?:[-+]?[0-9][0-9_.eE+-]*|true|false|null|~)\z"
    return F.when(F.rlike(value, F.lit(not_text)), "").otherwise(_unquoted(value))


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r"""\A(["'])(.*)\1\z""", "$2")
