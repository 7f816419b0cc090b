"""Vault paths: '/'-separated, relative to the vault root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    """Collapse repeated slashes and drop leading and trailing ones."""
    single = F.regexp_replace(path, "/{2,}", "/")
    return F.regexp_replace(single, r"\A/|/\z", "")


def normalize_path_text(path: str) -> str:
    """The same rule for a value known when the plan is built."""
    return "/".join(part for part in path.split("/") if part)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_of(path: Column) -> Column:
    """Everything before the last slash; empty for a file in the root."""
    return F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)


def base_name(path: Column) -> Column:
    """File name without its extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*\z", "")


def note_name(path: Column) -> Column:
    """File name without a trailing '.md'; other dots belong to the name."""
    return F.regexp_replace(file_name(path), r"\.md\z", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r".\.([^.]*)\z", 1)


def is_markdown(path: Column) -> Column:
    return F.endswith(path, F.lit(".md"))
