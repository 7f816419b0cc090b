"""User-supplied spam patterns, written for ECMAScript, matched by Spark.

Most patterns run inside the JVM as ``rlike``. Java matches a repeated group by
recursion, so on a long note such a pattern can overflow the executor's stack;
those, and the few that only Java rejects, run in Arrow batches instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from thicket.functions.text import SPACE

_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_INSIDE = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"

# What an ECMAScript token means, outside and inside [...].
_OUTSIDE_CLASS = {
    ".": r"[^\n\r\u2028\u2029]",
    "$": r"(?![\s\S])",
    "[^]": r"[\s\S]",
    "[]": r"(?!)",
    r"\b": _BOUNDARY,
    r"\B": _INSIDE,
    r"\d": "[0-9]",
    r"\D": "[^0-9]",
    r"\w": _WORD,
    r"\W": "[^A-Za-z0-9_]",
    r"\s": f"[{SPACE}]",
    r"\S": f"[^{SPACE}]",
    r"\v": r"\x0B",
    r"\0": r"\x00",
    "]": r"\]",
    "{": r"\{",
    "}": r"\}",
}
_TOP = chr(0x10FFFF)
_IN_CLASS = {
    r"\b": r"\x08",
    r"\d": "0-9",
    r"\D": r"\x00-\x2F\x3A-" + _TOP,
    r"\w": "A-Za-z0-9_",
    r"\W": r"\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-" + _TOP,
    r"\s": SPACE,
    r"\S": (
        r"\x00-\x08\x0E-\x1F\x21-\u009F\u00A1-\u167F\u1681-\u1FFF\u200B-\u2027"
        r"\u202A-\u202E\u2030-\u205E\u2060-\u2FFF\u3001-\uFEFE\uFF00-" + _TOP
    ),
    r"\v": r"\x0B",
    r"\0": r"\x00",
    "[": r"\[",
    "&": r"\&",
    "~": r"\~",
}
# Escaped letters that keep their meaning; any other escaped letter is itself.
_KEPT_ESCAPES = set("bBdDwWsSnrtfcxukv")

_TOKEN = re.compile(
    r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\k<\w+>|\\[\s\S]"
    r"|\[\^?\]|\[\^?|\]|\((?:\?(?:<[=!]|<\w+>|[:=!]|[ims-]*:|))?|\)"
    r"|\{\d+(?:,\d*)?\}\??|[*+?]\??|[\s\S]"
)
_QUANTIFIER = re.compile(r"\{(\d+)(,?)(\d*)\}\??|[*+?]\??")
# Repeating a group up to this often cannot exhaust a thread's stack.
_SAFE_REPEATS = 64


@dataclass(frozen=True)
class SpamPattern:
    source: str
    in_jvm: bool

    def matches(self, text: Column) -> Column:
        if self.in_jvm:
            return F.rlike(text, F.lit(self.source))
        return _search_in_batches(self.source)(text)


def compile_patterns(spark: SparkSession, raw: Iterable[str]) -> list[SpamPattern]:
    """Blank and invalid patterns are skipped, so one typo stops no scan."""
    compiled = []
    for pattern in (p.strip() for p in raw):
        if not pattern:
            continue
        try:
            source, recursive = translate(pattern)
        except ValueError:
            continue
        if not recursive and _valid_in_jvm(spark, source):
            compiled.append(SpamPattern(source, True))
        elif _valid_in_python(source):
            compiled.append(SpamPattern(source, False))
    return compiled


def translate(pattern: str) -> tuple[str, bool]:
    """The pattern in the dialect Java and Python share, and whether a group in
    it repeats without a small bound."""
    tokens = [m.group() for m in _TOKEN.finditer(pattern)]
    _loosen_last_group(tokens)
    out, in_class, recursive, previous = [], False, False, ""
    for token in tokens:
        quantifier = None if in_class else _QUANTIFIER.fullmatch(token)
        if quantifier and _QUANTIFIER.fullmatch(previous):
            raise ValueError("nothing to repeat")
        if token == "(?":
            raise ValueError("unknown group")
        if quantifier and previous == ")" and _most(quantifier) > _SAFE_REPEATS:
            recursive = True
        if quantifier:
            out.append(token)
        elif in_class and token in ("]", "[]", "[^]"):
            # '[]' cannot open inside a class: it is a literal '[' and the end.
            out.append({"]": "]", "[]": r"\[]", "[^]": r"\[^]"}[token])
        elif in_class and token in ("[", "[^"):
            out.append(r"\[" + token[1:])
        else:
            out.append(_meaning(token, _IN_CLASS if in_class else _OUTSIDE_CLASS))
        if in_class:
            in_class = token not in ("]", "[]", "[^]")
        else:
            in_class = token in ("[", "[^")
        previous = token
    # Without the u flag, case-insensitive matching never equates an ASCII and
    # a non-ASCII letter, so ASCII patterns fold ASCII letters only.
    flags = "(?i)" if _is_ascii(pattern) else "(?iu)"
    return flags + "".join(out), recursive


def _meaning(token: str, table: dict[str, str]) -> str:
    if token in table:
        return table[token]
    if len(token) == 2 and token[0] == "\\" and token[1].isalpha():
        return token if token[1] in _KEPT_ESCAPES else token[1]
    return token


def _most(quantifier: re.Match[str]) -> float:
    if not quantifier.group().startswith("{"):
        return 1 if quantifier.group().startswith("?") else float("inf")
    low, comma, high = quantifier.groups()
    if not comma:
        return int(low)
    return int(high) if high else float("inf")


def _loosen_last_group(tokens: list[str]) -> None:
    """Only whether a pattern matches counts, so repeats at its end beyond the
    required ones can go: (x){5,} becomes (x){5}."""
    if len(tokens) < 2 or tokens[-2] != ")":
        return
    last = _QUANTIFIER.fullmatch(tokens[-1])
    if last and _most(last) == float("inf"):
        least = last.group(1) or ("1" if last.group().startswith("+") else "0")
        tokens[-1] = "{" + least + "}"


def _is_ascii(pattern: str) -> bool:
    escapes = (int(code, 16) for code in re.findall(r"\\[ux]([0-9a-fA-F]{2,4})", pattern))
    return pattern.isascii() and all(code < 128 for code in escapes)


def _valid_in_jvm(spark: SparkSession, source: str) -> bool:
    try:
        spark.sql("SELECT rlike('', :pattern)", args={"pattern": source}).collect()
    except Exception:  # an invalid pattern surfaces as a query error
        return False
    return True


def _valid_in_python(source: str) -> bool:
    try:
        regex.compile(_python_form(source))
    except regex.error:
        return False
    return True


def _python_form(source: str) -> str:
    """Python folds beyond ASCII unless told not to; Java is the other way round."""
    ascii_only = source.startswith("(?i)")
    return source.replace("(?i)", "(?ia)", 1) if ascii_only else source


def _search_in_batches(source: str):
    form = _python_form(source)

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        # Only names from outside this package: workers need not have it.
        import regex as engine

        search = engine.compile(form).search
        return texts.map(lambda text: search(text) is not None)

    return found
