"""Row identity, words and joins that the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.durable import stored

# The white space between words, and what a word is.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

ROW = "_thicket_row"


def with_row_ids(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` (only ``columns`` if given) with a unique ``_thicket_row``, stored.

    ``doc_id`` may be null or repeated, so it cannot name a row. The number is
    given while the copy is written and read from it ever after. A column of that
    name in ``docs`` is taken to be such a number, unique and without nulls.
    """
    if ROW in docs.columns:
        return docs.select(ROW, *columns) if columns else docs
    kept = docs.select(*columns) if columns else docs
    return stored(kept.withColumn(ROW, F.monotonically_increasing_id()))


def salted_join(
    many: DataFrame, few: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = 16
) -> DataFrame:
    """Join on ``keys`` where one key may hold a large share of ``many``.

    ``few`` has at most one row a key and is repeated once for each salt; the
    rows of one key are dealt by a hash of ``spread`` to ``salts`` partitions.
    """
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
