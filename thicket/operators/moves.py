"""Moving notes to the trash folder without breaking links to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.config import Config
from thicket.functions import paths, text
from thicket.functions.paths import normalize_path_text
from thicket.operators.clutter import report_order
from thicket.operators.links import (
    LINK_TOKEN,
    link_mentions,
    link_target,
    link_tokens,
    resolve_states,
)
from thicket.operators.ranking import rank_in_group

TAKEN = "Destination file already exists!"


def plan_trash_moves(
    selected: DataFrame, all_paths: DataFrame, cfg: Config, now_ms: int
) -> DataFrame:
    """(path, new_path, status, error) for each selected note.

    In report order, the first note of a name gets the plain name if it is free
    in the trash. The others get a time stamp: ``now_ms``, then one millisecond
    more for each further note of that name. If even that path exists, the move
    fails and the note stays.
    """
    trash = normalize_path_text(cfg.trash_folder)
    path = F.col("path")
    ranked = rank_in_group(
        selected.select("path").distinct().withColumn("name", paths.file_name(path)),
        "name",
        report_order(),
        "place",
    )
    plain = F.concat(F.lit(trash + "/"), F.col("name"))
    taken = all_paths.select(F.col("path").alias("plain")).distinct()
    placed = (
        ranked.withColumn("plain", plain)
        .join(taken.withColumn("clash", F.lit(1)), "plain", "left")
        .withColumn(
            "stamp", F.col("place") - F.when(F.col("clash").isNull(), 2).otherwise(1)
        )
    )
    stamped = F.concat(
        F.lit(trash + "/"),
        paths.base_name(path),
        F.lit("-"),
        (F.lit(now_ms).cast("bigint") + F.col("stamp")).cast("string"),
        F.lit("."),
        paths.extension(path),
    )
    wanted = placed.select(
        "path",
        F.when(F.col("stamp") < 0, F.col("plain")).otherwise(stamped).alias("wanted"),
        (F.col("stamp") >= 0).alias("is_stamped"),
    )
    # A stamped path may exist already, or be the plain path of another move.
    in_use = taken.select(F.col("plain").alias("wanted")).unionByName(
        wanted.filter(~F.col("is_stamped")).select("wanted")
    )
    in_use = in_use.distinct().withColumn("in_use", F.lit(True))
    fails = F.col("is_stamped") & F.col("in_use").isNotNull()
    return wanted.join(in_use, "wanted", "left").select(
        "path",
        F.when(~fails, F.col("wanted")).alias("new_path"),
        F.when(fails, "error").otherwise("moved").alias("status"),
        F.when(fails, F.concat(path, F.lit(": " + TAKEN))).alias("error"),
    )


def done_moves(moves: DataFrame) -> DataFrame:
    return moves.filter(F.col("status") == "moved").select("path", "new_path")


def apply_moves(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """The corpus with moved notes under their new path."""
    return (
        notes.join(done_moves(moves), "path", "left")
        .withColumn("path", F.coalesce("new_path", "path"))
        .drop("new_path")
    )


def stale_links(notes: DataFrame, moves: DataFrame, files: DataFrame) -> DataFrame:
    """(src, target, new_target): link texts that would point elsewhere, or
    nowhere, after the moves.

    Every link is resolved before and after, in one pass; it is stale unless it still reaches
    the same file. Only links that a move can affect are looked at: those whose
    last part is the old or new name of a moved note, and those of moved notes.
    """
    done = done_moves(moves)
    mentions = link_mentions(notes).select("src", "target")
    each_path = F.explode(F.array("path", "new_path")).alias("path")
    names = done.select(each_path).select(
        F.explode(
            F.array(paths.file_name(F.col("path")), paths.base_name(F.col("path")))
        ).alias("name")
    )
    sources = done.select(F.col("path").alias("src"), F.col("new_path").alias("new_src"))
    touched = (
        mentions.withColumn("name", paths.file_name(F.col("target")))
        .join(names.distinct().withColumn("name_moved", F.lit(True)), "name", "left")
        .join(sources, "src", "left")
        .filter(F.col("name_moved").isNotNull() | F.col("new_src").isNotNull())
        .select("src", "target", F.coalesce("new_src", "src").alias("new_src"))
    )
    both = files.select("path").join(done, "path", "left").select("path", F.coalesce("new_path", "path").alias("after"))
    resolved = resolve_states(touched, both, ["src", "new_src"], ["path", "after"])
    expected = _renamed(resolved.filter("dst_0 IS NOT NULL"), done, "dst_0", "new_dst")
    return expected.filter(~F.col("dst_1").eqNullSafe(F.col("new_dst"))).select(
        "src", "target", F.regexp_replace("new_dst", r"\.md\z", "").alias("new_target")
    )


def rewrite_inbound_links(
    notes: DataFrame, moves: DataFrame, files: DataFrame | None = None
) -> DataFrame:
    """(path, content, n_applied) of notes whose links the moves would break.

    Such a link is rewritten to the full new path; its heading and its display
    text stay. Paths are those before the moves.
    """
    content, renames = F.col("content"), F.col("renames")
    return notes.join(_link_renames(notes, moves, files), "path").select(
        "path",
        _relinked(content, renames).alias("content"),
        F.size(F.filter(link_tokens(content), lambda t: renames[link_target(t)].isNotNull()))
        .cast("bigint")
        .alias("n_applied"),
    )


def moved_corpus(
    notes: DataFrame, moves: DataFrame, files: DataFrame | None = None
) -> DataFrame:
    """All notes after the moves, with links to moved notes kept whole.

    New links and new paths are joined first, so the texts are shuffled once.
    """
    changes = _link_renames(notes, moves, files).join(done_moves(moves), "path", "full")
    content, renames = F.col("content"), F.col("renames")
    relinked = F.when(renames.isNull(), content).otherwise(_relinked(content, renames))
    columns = {"path": F.coalesce("new_path", "path"), "content": relinked}
    return notes.join(changes, "path", "left").select(
        *(columns.get(c, F.col(c)).alias(c) for c in notes.columns)
    )


def _link_renames(notes: DataFrame, moves: DataFrame, files: DataFrame | None) -> DataFrame:
    """(path, renames): by old link text the new one, for each note that needs any."""
    reachable = (notes if files is None else files).select("path")
    return (
        stale_links(notes, moves, reachable)
        .groupBy(F.col("src").alias("path"))
        .agg(
            F.map_from_entries(F.collect_list(F.struct("target", "new_target"))).alias(
                "renames"
            )
        )
    )


def _relinked(content: Column, renames: Column) -> Column:
    body = text.strip_frontmatter(content)
    head = F.substring(content, F.lit(1), F.length(content) - F.length(body))
    new_tokens = F.transform(link_tokens(content), lambda t: _renamed_token(t, renames))
    woven = F.zip_with(
        F.split(body, LINK_TOKEN, -1),
        new_tokens,
        lambda gap, t: F.concat(gap, F.coalesce(t, F.lit(""))),
    )
    return F.concat(head, F.array_join(woven, ""))


def _renamed_token(token: Column, renames: Column) -> Column:
    new = renames[link_target(token)]
    opening = F.regexp_extract(token, r"\A!?\[\[", 0)
    rest = F.regexp_extract(token, r"\A!?\[\[[^\]|#]*([^\]]*\]\])\z", 1)
    return F.when(new.isNotNull(), F.concat(opening, new, rest)).otherwise(token)


def _renamed(rows: DataFrame, done: DataFrame, column: str, new: str) -> DataFrame:
    moved = done.select(F.col("path").alias(column), F.col("new_path").alias(new))
    return rows.join(moved, column, "left").withColumn(new, F.coalesce(new, column))
