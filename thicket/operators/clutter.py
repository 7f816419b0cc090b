"""Which notes are clutter, and why."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.config import Config
from thicket.functions import text
from thicket.functions.once import computed
from thicket.functions.paths import normalize_path_text
from thicket.functions.patterns import compile_patterns
from thicket.operators.links import connected_paths
from thicket.operators.metadata import note_tags, with_metadata
from thicket.operators.ranking import shuffled_once


def in_trash(path: Column, cfg: Config) -> Column:
    trash = normalize_path_text(cfg.trash_folder)
    return (path == trash) | F.startswith(path, F.lit(trash + "/"))


def in_ignored_folder(path: Column, cfg: Config) -> Column:
    inside = [F.startswith(path, F.lit(p + "/")) for p in cfg.ignored_prefixes()]
    return reduce(lambda a, b: a | b, inside, F.lit(False))


def has_protected_tag(tags: Column, cfg: Config) -> Column:
    wanted = cfg.protected_tag_set()
    if not wanted:
        return F.lit(False)
    return F.coalesce(
        F.arrays_overlap(tags, F.array(*(F.lit(t) for t in wanted))), F.lit(False)
    )


def protection(notes: DataFrame, cfg: Config) -> Column:
    """Whether a note is off limits; folder rules come first, being cheap."""
    path = F.col("path")
    return (
        in_trash(path, cfg)
        | in_ignored_folder(path, cfg)
        | has_protected_tag(note_tags(notes), cfg)
    )


def protected_notes(notes: DataFrame, cfg: Config) -> DataFrame:
    described = with_metadata(notes)
    return described.filter(protection(described, cfg)).select(*notes.columns)


def unprotected_notes(notes: DataFrame, cfg: Config) -> DataFrame:
    described = with_metadata(notes)
    return described.filter(~protection(described, cfg)).select(*notes.columns)


def flag_clutter(notes: DataFrame, cfg: Config, links: DataFrame | None = None) -> DataFrame:
    """(path, reasons, words) of every flagged note.

    Everything that needs the text is decided in the scan itself. Only paths and
    flags go on from there, so the orphan join never shuffles note content.
    """
    if cfg.flag_orphans and links is None:
        raise ValueError("flag_orphans needs the links of the notes")
    measured = (
        unprotected_notes(notes, cfg)
        .select("path", computed(body=text.body(F.col("content"))))
        .select(
            "path",
            computed(
                words=text.word_count(F.col("body")),
                is_empty=F.col("body") == "",
                is_spam=_is_spam(notes, cfg),
                urls=_urls(cfg),
                url_words=_url_words(cfg),
            ),
        )
    )
    if cfg.flag_orphans:
        linked = connected_paths(links).withColumn("has_link", F.lit(True))
        measured = measured.join(linked, "path", "left").withColumn(
            "is_orphan", F.col("has_link").isNull()
        )
    else:
        measured = measured.withColumn("is_orphan", F.lit(False))
    return (
        measured.select("path", _reasons(cfg).alias("reasons"), "words")
        .filter(F.size("reasons") > 0)
        .select("path", "reasons", "words")
    )


def in_report_order(rows: DataFrame) -> DataFrame:
    return shuffled_once(rows, F.col("path")).orderBy(*report_order())


def report_order() -> list[Column]:
    """Alphabetical as people read it; binary order between equal spellings."""
    return [F.collate(F.col("path"), "UNICODE"), F.col("path")]


def clutter_summary(flagged: DataFrame) -> DataFrame:
    return (
        flagged.select(F.explode("reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count("*").alias("notes"))
    )


def _is_spam(notes: DataFrame, cfg: Config) -> Column:
    if not cfg.flag_spam:
        return F.lit(False)
    patterns = compile_patterns(notes.sparkSession, cfg.spam_patterns)
    hits = [p.matches(F.col("body")) for p in patterns]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def _urls(cfg: Config) -> Column:
    if not cfg.flag_link_farms:
        return F.lit(0).cast("bigint")
    return text.url_count(F.col("body"))


def _url_words(cfg: Config) -> Column:
    """Words inside URLs, where those are not to count against a link farm."""
    if not (cfg.flag_link_farms and cfg.link_farm_exclude_urls_from_words):
        return F.lit(0).cast("bigint")
    body = text.without_code(F.col("body"))
    return text.word_count(F.col("body")) - text.word_count(F.regexp_replace(body, text.URL, " "))


def _reasons(cfg: Config) -> Column:
    size_reason = F.when(F.lit(cfg.flag_empty) & F.col("is_empty"), "empty").when(
        F.lit(cfg.flag_stubs) & (F.col("words") < cfg.stub_min_words), "stub"
    )
    farm = (
        F.lit(cfg.flag_link_farms)
        & (F.col("urls") >= cfg.link_farm_min_urls)
        & (F.col("urls") >= F.col("words") - F.col("url_words"))
    )
    return F.array_compact(
        F.array(
            size_reason,
            F.when(F.col("is_orphan"), "orphan"),
            F.when(F.col("is_spam"), "spam"),
            F.when(farm, "link-farm"),
        )
    )
