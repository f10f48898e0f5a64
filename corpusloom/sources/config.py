"""Settings from a TOML file, with strict keys."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

FILE_NAME = "corpusloom.toml"


class ConfigError(ValueError):
    """A setting that does not exist, or one with the wrong type."""


@dataclass(frozen=True)
class Profile:
    """What a corpus is meant for; empty limits are not graded."""

    intended_use: str = ""
    required_topics: tuple[str, ...] = ()
    max_duplication_pct: float | None = None
    min_words: int | None = None

    def __post_init__(self):
        if any(not t.strip() for t in self.required_topics):
            raise ConfigError("a required topic is empty; it would match any tag")


@dataclass(frozen=True)
class Config:
    """The defaults."""

    target_words: int = 180
    min_words: int = 20
    max_tier: int = 2
    enabled: tuple[str, ...] = ()
    near_duplicate: float = 0.95
    boilerplate_min_files: int = 3
    generic_threshold: float = 0.82
    length_short: int = 25
    length_long: int = 400
    top_k: int = 5
    topic_similarity: float = 0.70
    max_topics: int = 12
    label_words: int = 600
    profile: Profile | None = None

    def merged(self, **overrides) -> Config:
        """With every override that is not None."""
        known = {f.name for f in fields(self)}
        if odd := sorted(set(overrides) - known):
            raise ConfigError(f"unknown setting: {', '.join(odd)}")
        return replace(self, **{k: v for k, v in overrides.items() if v is not None})


#: The sections a setting may stand in, besides [profile].
SECTIONS = ("chunking", "signals", "thresholds", "retrieval", "inventory")


def find(start: str | Path, file_name: str = FILE_NAME) -> Path | None:
    """The nearest settings file at ``start`` or above."""
    here = Path(start).resolve()
    return next((p / file_name for p in (here, *here.parents) if (p / file_name).is_file()), None)


def load(start: str | Path, file_name: str = FILE_NAME) -> Config:
    """Settings for the folder ``start``; defaults where no file is found.

    Unknown sections, settings and profile keys raise ``ConfigError``.
    """
    path = find(start, file_name)
    if path is None:
        return Config()
    values: dict = {}
    for section, body in tomllib.loads(path.read_text(encoding="utf-8")).items():
        if section != "profile" and section not in SECTIONS:
            raise ConfigError(f"{path}: unknown section [{section}]")
        if not isinstance(body, dict):
            raise ConfigError(f"{path}: {section} stands outside any section")
        known = {f.name for f in fields(Profile if section == "profile" else Config)} - {"profile"}
        if odd := sorted(set(body) - known):
            raise ConfigError(f"{path}: unknown in [{section}]: {', '.join(odd)}")
        body = {k: tuple(v) if isinstance(v, list) else v for k, v in body.items()}
        values |= {"profile": Profile(**body)} if section == "profile" else body
    return Config(**values)
