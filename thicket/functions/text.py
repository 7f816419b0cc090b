"""Text measures and text edits on Markdown note content.

Offsets are code points, so ``substring(content, start + 1, end - start)`` is
the matched text. Where a length decides something (minimum title length,
longest title first) it is counted in UTF-16 units, see ``utf16_length``.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from thicket.functions.folds import count_below, running
from thicket.functions.once import evaluate_once

# The white space of ECMAScript, which is wider than Java's \s.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
# A character that continues a word for the whole-word rule.
WORD_CHAR = r"\p{L}\p{N}_"

# Patterns of the parts of a note.
FRONTMATTER = r"\A---\r?\n[\s\S]*?\r?\n---\r?\n?"
FENCED_CODE = r"```[\s\S]*?```"
INLINE_CODE = r"`[^`]*`"
URL = rf"(?i)https?://[^{SPACE}]+"
# Markdown punctuation never joins a word, and a hyphen counts as such, so a
# word is a run of letters, digits and plain apostrophes.
WORD = r"[\p{L}\p{N}][\p{L}\p{N}']*"

CONTEXT_WIDTH = 40
_PAGE_BITS = 10
PAGE = 1 << _PAGE_BITS

# Where the letters lie whose simple folding is not their lower case, as a few
# ranges, because a class of many single characters is slow to test.
_FOLD_BLOCKS = r"[\u00B5\u0130\u017F\u0370-\u03FF\u13A0-\u13FF\u1C80-\u1C8F\u1E00-\u1FFF\uAB70-\uABBF\uFB05]"


def js_trim(text: Column) -> Column:
    # The look-behind starts a match only where a run of spaces starts, which
    # keeps a long run inside the text linear. Most texts need no trimming.
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    trimmed = F.regexp_replace(
        text, rf"\A[{SPACE}]+|(?<![{SPACE}])[{SPACE}]+\z", ""
    )
    return F.when(F.rlike(ends, F.lit(f"[{SPACE}]")), trimmed).otherwise(text)


def strip_frontmatter(content: Column) -> Column:
    stripped = F.regexp_replace(content, FRONTMATTER, "")
    return F.when(F.startswith(content, F.lit("---")), stripped).otherwise(content)


def frontmatter(content: Column) -> Column:
    """The leading metadata block, or an empty string."""
    block = F.regexp_extract(content, FRONTMATTER, 0)
    return F.when(F.startswith(content, F.lit("---")), block).otherwise("")


def body(content: Column) -> Column:
    return evaluate_once(strip_frontmatter(content), js_trim)


def without_code(text: Column) -> Column:
    """Code spans replaced by a space: fenced blocks first, then inline code."""
    no_fence = F.regexp_replace(text, FENCED_CODE, " ")
    no_code = F.regexp_replace(no_fence, INLINE_CODE, " ")
    return F.when(F.contains(text, F.lit("`")), no_code).otherwise(text)


def word_count(text: Column) -> Column:
    return F.regexp_count(without_code(text), F.lit(WORD)).cast("bigint")


def url_count(text: Column) -> Column:
    found = F.regexp_count(text, F.lit(URL))
    return F.when(F.contains(text, F.lit("://")), found).otherwise(0).cast("bigint")


def utf16_length(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16BE")) / F.lit(2)


def normalize_tag(tag: Column) -> Column:
    return F.lower(F.regexp_replace(tag, r"\A#", ""))


def reason_labels(reasons: Column) -> Column:
    return F.replace(F.array_join(reasons, ", "), F.lit("link-farm"), F.lit("link farm"))


def wikilink(target: Column, matched: Column) -> Column:
    plain = F.concat(F.lit("[["), target, F.lit("]]"))
    piped = F.concat(F.lit("[["), target, F.lit("|"), matched, F.lit("]]"))
    return F.when(matched == target, plain).otherwise(piped)


def text_slice(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def line_starts(content: Column) -> Column:
    """Where each line begins, for ``line_number``: made once a text."""
    widths = F.transform(F.split(content, "\n", -1), lambda line: F.length(line) + 1)
    first = F.array(F.lit(0))
    return F.concat(first, evaluate_once(running(widths, lambda a, b: a + b), lambda ends: F.slice(ends, F.lit(1), F.size(ends) - 1)))


def line_number(starts: Column, at: Column) -> Column:
    """The line, from 1, of a place in the text whose ``line_starts`` are given."""
    return count_below(starts, at, inclusive=True).cast("bigint")


def pages(content: Column) -> Column:
    """The text in pieces of ``PAGE`` characters, for ``page_slice``: made once a text.

    A place deep in a string is found by walking there; in a page it is near.
    """
    return F.regexp_extract_all(content, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def page_slice(whole: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``, of its ``pages``; what lies outside is left out."""

    def piece(first: Column) -> Column:
        last = F.shiftright(end - 1, _PAGE_BITS)
        count = F.greatest(last - first + 1, F.lit(0))
        held = F.when(count <= 1, F.coalesce(F.get(whole, first), F.lit(""))).otherwise(
            F.array_join(F.slice(whole, first + 1, count), "")
        )
        return F.substring(held, start - first * PAGE + 1, F.greatest(end - start, F.lit(0)))

    return evaluate_once(F.shiftright(start, _PAGE_BITS), piece)


def context_around(whole: Column, start: Column, end: Column) -> Column:
    """The match in bold with up to 40 characters of its line on either side, from a text's ``pages``."""
    width = CONTEXT_WIDTH

    def clipped_left(before: Column) -> Column:
        shortened = F.concat(F.lit("…"), F.right(before, F.lit(width)))
        return F.when(F.length(before) > width, shortened).otherwise(before)

    def clipped_right(after: Column) -> Column:
        shortened = F.concat(F.left(after, F.lit(width)), F.lit("…"))
        return F.when(F.length(after) > width, shortened).otherwise(after)

    # One character more than is shown tells whether the line goes on.
    near_start = F.greatest(start - (width + 1), F.lit(0))
    before = F.substring_index(page_slice(whole, near_start, start), "\n", -1)
    after = F.substring_index(page_slice(whole, end, end + width + 1), "\n", 1)
    shown = F.concat(
        evaluate_once(before, clipped_left),
        F.lit("**"),
        page_slice(whole, start, end),
        F.lit("**"),
        evaluate_once(after, clipped_right),
    )
    return evaluate_once(shown, js_trim)


def splice(whole: Column, size: Column, edits: Column) -> Column:
    """Put ``edits`` (start, end, replacement; sorted, disjoint) into a text of ``size`` characters, given as ``pages``."""

    def resume_at(index: Column) -> Column:
        previous = F.get(edits, index - 1)["end"]
        return F.when(index == 0, 0).otherwise(previous)

    head = F.transform(
        edits,
        lambda edit, i: F.concat(page_slice(whole, resume_at(i), edit["start"]), edit["replacement"]),
    )
    return F.concat(F.array_join(head, ""), page_slice(whole, resume_at(F.size(edits)), size))


def fold_case(text: Column) -> Column:
    """Simple case folding: one character in, one character out.

    ``lower`` differs from it only for a few letters (long s, final sigma,
    Cherokee, ...); those take the slower path through ``translate``.
    """
    dotted, stand_in = "\u0130", "\uFDD0"
    source, target = _fold_exceptions()
    guarded = F.lower(F.translate(text, dotted, stand_in))
    exact = F.translate(guarded, source + stand_in, target + dotted)
    return F.when(F.rlike(text, F.lit(_FOLD_BLOCKS)), exact).otherwise(F.lower(text))


@lru_cache(maxsize=1)
def _fold_exceptions() -> tuple[str, str]:
    """Letters of the basic plane whose simple folding is not their lower case.

    The iota subscript mark is left out: it is no letter but folds to one, which
    would move word boundaries.
    """
    pairs = []
    for code in range(0x80, 0x10000):
        char = chr(code)
        low, folded = char.lower(), char.casefold()
        if len(low) == 1 and len(folded) == 1 and folded != low and code != 0x345:
            pairs.append((low, folded))
    pairs = sorted(set(pairs))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
