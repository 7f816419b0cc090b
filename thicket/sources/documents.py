"""Notes derived from a plain document table.

Plain prose has no links, metadata, code or URLs, so each document is dressed
as a note: by its number it gets a folder, a title from its first words, and
one feature of Markdown notes. Every document becomes exactly one note.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.once import computed

FENCE = "```"


def notes_from_documents(documents: DataFrame) -> DataFrame:
    """(path, content) of (doc_id, text, source).

    Only notes that link to the next document are joined with its title; the texts of all others
    stay where they are. With repeated ids every text is joined, as each copy of the next document
    gives a note of its own.
    """
    d = F.col("doc_id")
    title = _title(F.col("text"), d)
    titled = documents.select("doc_id", "text", "source", title.alias("title"))
    following = documents.select((d - 1).alias("doc_id"), title.alias("next_title"))
    if _ids_repeat(documents):
        joined = titled.join(following, "doc_id", "left")
    else:
        linking = _links_to_next(d)
        alone = titled.filter(~F.coalesce(linking, F.lit(False))).withColumn("next_title", F.lit(None).cast("string"))
        joined = titled.filter(linking).join(following.filter(linking), "doc_id", "left").unionByName(alone)
    folder = (
        F.when(d % 23 == 0, F.lit("_trash"))
        .when(d % 29 == 0, F.lit("Templates"))
        .otherwise(F.col("source"))
    )
    return joined.select(
        F.concat(folder, F.lit("/"), d, F.lit("/"), F.col("title"), F.lit(".md")).alias("path"),
        computed(content=_content(d)),
    )


def _ids_repeat(documents: DataFrame) -> bool:
    ids = documents.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    return not ids.filter("n > 1").isEmpty()


def _links_to_next(d: Column) -> Column:
    """Whether ``_content`` reads the next title: by five, and by none of the numbers that come first."""
    linking = d % 5 == 0
    for number in (7, 11, 13, 17, 19):
        linking = linking & (d % number != 0)
    return linking


def _title(text: Column, number: Column) -> Column:
    words = F.regexp_extract(text, r"^[\p{L}\p{N}]+ [\p{L}\p{N}]+", 0)
    return F.when(words == "", F.concat(F.lit("note"), number)).otherwise(words)


def _content(d: Column) -> Column:
    text = F.col("text")
    links = "\n".join(f"https://ex.com/{i}" for i in range(1, 7))
    link = F.concat(F.lit("[["), F.coalesce("next_title", F.lit("missing")), F.lit("]]"))
    see = F.concat(F.lit("\nSee "), link, F.lit(" and "), link, F.lit(", not [[nowhere "), d, F.lit("]]"))
    alias = F.concat(F.lit("---\naliases: ["), F.col("title"), F.lit(" alt]\n---\n"))
    one_alias = F.concat(F.lit("---\naliases: "), F.col("title"), F.lit(" alt\n---\n"))
    marks = " `https://ex.com/a` and https://ex.com/b [text](https://ex.com/c) #Topic/x"
    return (
        F.when(d % 11 == 0, F.lit("---\ntags: [x]\n---\n  \n"))
        .when(d % 13 == 0, F.concat(text, F.lit(" Free Money now")))
        .when(d % 17 == 0, F.lit(f"{FENCE}\n{links}\n{FENCE}"))
        .when(d % 38 == 19, F.concat(F.lit("---\ntags:\n- keep\n- x\n---\n"), text))
        .when(d % 19 == 0, F.concat(F.lit("---\ntags: [keep, x]\n---\n"), text))
        .when(d % 14 == 7, F.concat(one_alias, text))
        .when(d % 7 == 0, F.concat(alias, text))
        .when(d % 5 == 0, F.concat(text, see))
        .when(d % 3 == 0, F.concat(text, F.lit(marks)))
        .otherwise(text)
    )
