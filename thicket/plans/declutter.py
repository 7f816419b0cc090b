"""Find clutter, review it, move it to the trash."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.config import Config
from thicket.durable import durable
from thicket.operators.clutter import flag_clutter, in_report_order
from thicket.operators.links import resolve_links
from thicket.operators.moves import done_moves, moved_corpus, plan_trash_moves, rewrite_inbound_links
from thicket.plans.reports import accepted_only
from thicket.sources import snapshots


@dataclass(frozen=True)
class TrashResult:
    moves: DataFrame
    notes: DataFrame


def scan(
    notes: DataFrame,
    cfg: Config,
    links: DataFrame | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """Flagged notes in report order. The links are read only if orphans count."""
    if cfg.flag_orphans and links is None:
        links = resolve_links(notes, files)
    return in_report_order(flag_clutter(notes, cfg, links))


def trash(
    notes: DataFrame,
    flagged: DataFrame,
    cfg: Config,
    now_ms: int,
    accepted: DataFrame | None = None,
    files: DataFrame | None = None,
) -> TrashResult:
    """The moves, and the corpus after them with links to moved notes kept whole."""
    everything = notes.select("path") if files is None else files
    chosen = accepted_only(flagged, accepted, ["path"])
    moves = plan_trash_moves(chosen, everything, cfg, now_ms)
    return TrashResult(moves, moved_corpus(notes, moves, everything))


def trash_in(
    spark: SparkSession,
    location: str,
    flagged: DataFrame,
    cfg: Config,
    now_ms: int,
    accepted: DataFrame | None = None,
    files: DataFrame | None = None,
) -> int:
    """Make the moves in the latest version of a stored corpus; the new version's number.

    Only buckets of moved notes, of their new places and of notes whose links change are written.
    """
    notes = snapshots.read(spark, location)
    everything = notes.select("path") if files is None else files
    moves = durable(plan_trash_moves(accepted_only(flagged, accepted, ["path"]), everything, cfg, now_ms))
    relinked = rewrite_inbound_links(notes, moves, everything).select("path", "content")
    changes = done_moves(moves).join(relinked, "path", "full").withColumn("new_path", F.coalesce("new_path", "path"))
    return snapshots.change(spark, location, durable(changes))
