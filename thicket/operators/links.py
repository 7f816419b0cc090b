"""The link graph: which note links to which file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.durable import durable
from thicket.functions import paths, text

# Code spans are taken first, so a link inside code is never seen as one.
LINK_TOKEN = rf"{text.FENCED_CODE}|{text.INLINE_CODE}|!?\[\[[^\]]*?\]\]"
_LINK_PARTS = r"\A!?\[\[([^\]|#]*)([^\]]*)\]\]\z"


def link_tokens(content: Column) -> Column:
    """Code spans and wikilinks of the note body, in order."""
    found = F.regexp_extract_all(
        text.strip_frontmatter(content), F.lit(LINK_TOKEN), F.lit(0)
    )
    nothing = F.array().cast("array<string>")
    return F.when(F.contains(content, F.lit("[[")), found).otherwise(nothing)


def link_target(token: Column) -> Column:
    """The file part of a wikilink; empty for a code span or a same-note link."""
    return paths.normalize_path(F.trim(F.regexp_extract(token, _LINK_PARTS, 1)))


def link_mentions(notes: DataFrame) -> DataFrame:
    """(src, target, n): every distinct link text of a note and its count."""
    return (
        notes.select(
            F.col("path").alias("src"),
            F.explode(F.transform(link_tokens(F.col("content")), link_target)).alias(
                "target"
            ),
        )
        .filter(F.col("target") != "")
        .groupBy("src", "target")
        .agg(F.count("*").alias("n"))
    )


def resolve(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``dst`` to (src, target, ...); null where no file answers to the text.

    Exact path first (with or without '.md'), then the same path seen from the
    source's folder, then the file of that name with the shortest path.
    """
    return resolve_states(mentions, files.select("path"), ["src"], ["path"]).withColumnRenamed("dst_0", "dst")


def resolve_states(mentions: DataFrame, files: DataFrame, sources: list[str], states: list[str]) -> DataFrame:
    """Add ``dst_0``, ``dst_1``, ...: what each link reaches when its note lies at the first of
    ``sources`` and the files at the first of ``states``, at the second of both, and so on.

    Every link asks for the keys that would answer it, each with a rank; all are looked up
    in one join, and the smallest rank wins. The table has one row a key and state, so a
    name that many files share never multiplies the links to it; it is written first,
    so that the rows of a link that is everywhere may be split.
    """
    asked = F.array(
        *(
            F.struct(F.lit(i).alias("state"), F.lit(rank).alias("rank"), key.alias("key"))
            for i, source in enumerate(sources)
            for rank, key in enumerate(_keys_asked(F.col("target"), F.col(source)))
        )
    )
    rows = mentions.withColumn("asked", F.explode(asked)).select(*mentions.columns, "asked.*")
    found = rows.join(_answers(files, states), ["key", "state"], "left")
    best = [
        F.min(F.when((F.col("state") == i) & F.col("found").isNotNull(), F.struct("rank", "found")))["found"].alias(f"dst_{i}")
        for i in range(len(states))
    ]
    return found.groupBy(*mentions.columns).agg(*best)


def _keys_asked(target: Column, source: Column) -> list[Column]:
    """The keys of a link in the order in which they are tried; null for none."""
    folder = paths.folder_of(source)
    nearby = F.when(folder == "", target).otherwise(F.concat(folder, F.lit("/"), target))
    # No file name has a slash. A key of its own answers nothing and spreads.
    bare = F.when(F.contains(target, F.lit("/")), F.concat(F.lit("none "), target)).otherwise(_by_name(target))
    return [_by_path(target), _by_path(F.coalesce(nearby, target)), bare]


def _answers(files: DataFrame, states: list[str]) -> DataFrame:
    """(key, state, found): per key the best file: kind of key, then shortest path, then binary order."""
    at = F.explode(
        F.array(*(F.struct(F.lit(i).alias("state"), F.col(path).alias("path")) for i, path in enumerate(states)))
    ).alias("at")
    path = F.col("path")
    keys = [
        (0, _by_path(path)),
        (1, _by_path(F.regexp_replace(path, r"\.md\z", ""))),
        (0, _by_name(paths.file_name(path))),
        (1, _by_name(_note_name(path))),
    ]
    entries = F.array(*(F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in keys))
    best = F.min(F.struct("kind", F.length("path").alias("size"), "path"))
    table = (
        files.select(at)
        .select("at.state", "at.path")
        .select("state", "path", F.inline(entries))
        .filter("key IS NOT NULL")
        .groupBy("key", "state")
        .agg(best["path"].alias("found"))
    )
    return durable(table)


def _by_path(path: Column) -> Column:
    return F.concat(F.lit("path "), path)


def _by_name(name: Column) -> Column:
    return F.concat(F.lit("name "), name)


def resolve_links(notes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(src, dst, n): the resolved link graph. ``files`` are all paths a link may
    reach, by default the notes themselves."""
    reachable = (notes if files is None else files).select("path")
    return (
        resolve(link_mentions(notes), reachable)
        .filter(F.col("dst").isNotNull())
        .groupBy("src", "dst")
        .agg(F.sum("n").alias("n"))
    )


def unresolved_links(notes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    reachable = (notes if files is None else files).select("path")
    return resolve(link_mentions(notes), reachable).filter(F.col("dst").isNull()).drop(
        "dst"
    )


def linked_targets(links: DataFrame) -> DataFrame:
    return links.select(F.col("dst").alias("path")).distinct()


def connected_paths(links: DataFrame) -> DataFrame:
    """Every path with a link in or out."""
    ends = F.explode(F.array("src", "dst")).alias("path")
    return links.select(ends).distinct()


def orphans(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes that no link enters or leaves; a link to itself counts as both."""
    return nodes.join(connected_paths(links), "path", "left_anti")


def _note_name(path: Column) -> Column:
    return F.when(paths.is_markdown(path), paths.base_name(path))
