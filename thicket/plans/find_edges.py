"""Find missing links, review them, write them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.config import Config
from thicket.durable import durable
from thicket.operators.edges import apply_links, linked_corpus, stored_suggestions
from thicket.operators.ranking import shuffled_once
from thicket.sources import snapshots


@dataclass(frozen=True)
class LinkResult:
    changed: DataFrame
    notes: DataFrame


def scan(notes: DataFrame, cfg: Config) -> DataFrame:
    """Suggested links by note and place."""
    found, is_shuffled = stored_suggestions(notes, cfg)
    if not is_shuffled:
        # By path alone they lie together already, and no shuffle would be made.
        found = shuffled_once(found, F.col("path"), F.col("start"))
    return found.orderBy("path", "start")


def insert(notes: DataFrame, cfg: Config, accepted: DataFrame | None = None) -> LinkResult:
    """Write accepted links into the notes as they are now. Notes that are gone
    since the scan are passed over."""
    linked = linked_corpus(notes, cfg, accepted)
    changed = linked.filter(F.col("n_applied") > 0).select("path", "content", "n_applied")
    return LinkResult(changed, linked.drop("n_applied"))


def insert_into(
    spark: SparkSession, location: str, cfg: Config, accepted: DataFrame | None = None
) -> int:
    """Write accepted links into the latest version of a stored corpus; the new version's number.

    Only buckets of notes that change are written (see ``sources.snapshots``).
    """
    changed = durable(apply_links(snapshots.read(spark, location), cfg, accepted))
    return snapshots.change(spark, location, changed.withColumn("new_path", F.col("path")))
