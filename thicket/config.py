"""Settings for both analyses."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields, replace

# Default lists.
DEFAULT_PROTECT_TAGS = ("keep",)
DEFAULT_IGNORE_FOLDERS = ("Templates/", ".obsidian/")
DEFAULT_SPAM_PATTERNS = (
    r"\b(viagra|casino|crypto\s*giveaway|free\s*money)\b",
    r"(https?:\/\/\S+\s*){5,}",
)


def parse_list(text: str) -> tuple[str, ...]:
    """Split a multi-line setting into its trimmed, non-blank lines."""
    lines = (line.strip() for line in text.split("\n"))
    return tuple(line for line in lines if line)


@dataclass(frozen=True)
class Config:
    # Where approved clutter goes.
    trash_folder: str = "_trash"
    # Clutter rules.
    flag_empty: bool = True
    flag_stubs: bool = True
    stub_min_words: int = 5
    flag_orphans: bool = False
    flag_spam: bool = True
    spam_patterns: tuple[str, ...] = DEFAULT_SPAM_PATTERNS
    flag_link_farms: bool = True
    link_farm_min_urls: int = 5
    # Notes no clutter rule may touch.
    protect_tags: tuple[str, ...] = DEFAULT_PROTECT_TAGS
    ignore_folders: tuple[str, ...] = DEFAULT_IGNORE_FOLDERS
    # Missing-link rules; a cap of 0 means no cap.
    link_min_title_length: int = 4
    link_whole_word: bool = True
    link_case_sensitive: bool = False
    link_max_per_note: int = 20
    link_use_aliases: bool = True
    # Off by default, as these change what is found: pass over targets a note links
    # already, leave metadata alone, pass over protected notes, and do not count
    # URLs as words of a link farm.
    skip_already_linked: bool = False
    protect_frontmatter: bool = False
    respect_protection: bool = False
    link_farm_exclude_urls_from_words: bool = False
    # The dictionary of titles is broadcast only below this measured size;
    # above it the mention search is a shuffle join.
    broadcast_limit_bytes: int = 64 * 1024 * 1024

    def __post_init__(self) -> None:
        object.__setattr__(self, "trash_folder", self.trash_folder.strip() or "_trash")
        for name in ("spam_patterns", "protect_tags", "ignore_folders"):
            value = getattr(self, name)
            value = parse_list(value) if isinstance(value, str) else tuple(value)
            object.__setattr__(self, name, value)
        lower_bounds = {
            "stub_min_words": 0,
            "link_farm_min_urls": 1,
            "link_min_title_length": 1,
            "link_max_per_note": 0,
        }
        for name, least in lower_bounds.items():
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")

    @classmethod
    def from_settings(cls, stored: Mapping[str, object] | None) -> Config:
        """Lay stored camelCase settings over the defaults, key by key.

        A stored list replaces the default list. Unknown keys are ignored.
        """
        known = {f.name for f in fields(cls)}
        given = {_snake(key): value for key, value in (stored or {}).items()}
        return replace(cls(), **{k: v for k, v in given.items() if k in known})

    def exact_case(self) -> Config:
        return replace(self, link_case_sensitive=True)

    def protected_tag_set(self) -> tuple[str, ...]:
        """Protected tags as compared: one leading '#' off, then trimmed, lower case."""
        return _distinct(t.removeprefix("#").strip().lower() for t in self.protect_tags)

    def ignored_prefixes(self) -> tuple[str, ...]:
        return _distinct(f.strip().rstrip("/") for f in self.ignore_folders)


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def _distinct(values: Iterable[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(v for v in values if v))
