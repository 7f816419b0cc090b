"""What a reviewer sees, what they accept, and what came of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.text import reason_labels
from thicket.operators.clutter import report_order
from thicket.operators.ranking import rank_in_group


def clutter_report(flagged: DataFrame) -> DataFrame:
    """(title, detail, checked) of flagged notes."""
    words = F.concat(F.lit(" · "), F.col("words"), F.lit(" word(s)"))
    return flagged.select(
        F.col("path").alias("title"),
        F.concat(reason_labels(F.col("reasons")), words).alias("detail"),
        F.lit(True).alias("checked"),
    )


def clutter_places(flagged: DataFrame) -> DataFrame:
    """(path, place): each flagged note's place, from 1, in the order of the report.

    Ranked by range parts, so no task holds the whole report.
    """
    everything = flagged.select("path", F.lit(0).alias("_report"))
    return rank_in_group(everything, "_report", report_order(), "place").select("path", "place")


def edge_report(suggestions: DataFrame) -> DataFrame:
    """(title, detail, checked) of suggested links."""
    return suggestions.select(
        F.concat("path", F.lit("  →  [["), "target", F.lit("]]")).alias("title"),
        F.concat(F.lit("line "), F.col("line"), F.lit(": "), "context").alias("detail"),
        F.lit(True).alias("checked"),
    )


def accepted_only(
    proposed: DataFrame, accepted: DataFrame | None, keys: list[str]
) -> DataFrame:
    """The proposals a reviewer accepted; all of them if there was no review."""
    if accepted is None:
        return proposed
    return proposed.join(accepted.select(*keys), keys, "left_semi")


def item_count(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("items"))


def move_summary(moves: DataFrame) -> DataFrame:
    return moves.agg(
        F.count_if(F.col("status") == "moved").alias("moved"),
        F.count_if(F.col("status") == "error").alias("failed"),
    )


def move_errors(moves: DataFrame) -> DataFrame:
    """The messages of failed moves, one row each, as there may be many."""
    return moves.filter(F.col("status") == "error").select("path", "error")


def apply_summary(changed: DataFrame) -> DataFrame:
    return changed.agg(
        F.coalesce(F.sum("n_applied"), F.lit(0)).alias("applied"),
        F.count_if(F.col("n_applied") > 0).alias("notes"),
    )
