"""Thicket: keep large collections of linked Markdown notes clean, on Spark."""

from thicket.config import Config

__all__ = ["Config"]
