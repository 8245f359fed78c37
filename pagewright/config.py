"""Settings, from defaults and a TOML file; unknown keys are ignored."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Import:
    max_bytes: int = 0
    max_pages: int = 0
    auto_upgrade: bool = True


@dataclass(frozen=True)
class Quality:
    upgrade_below: float = 0.75
    upgrade_math_pages: bool = True
    max_upgrade_pages: int = 0


@dataclass(frozen=True)
class Repair:
    greek_lexicon: str = ""


@dataclass(frozen=True)
class Vision:
    enabled: bool = False
    min_confidence: float = 0.80
    min_greek_ratio: float = 0.35
    crop_retry: bool = True


@dataclass(frozen=True)
class Search:
    max_results: int = 10
    stem_headings: bool = False


@dataclass(frozen=True)
class Response:
    max_snippet_chars: int = 320
    max_page_chars: int = 12_000
    max_response_tokens: int = 6_000
    image_tokens: int = 900


@dataclass(frozen=True)
class Chunking:
    target_chars: int = 1800
    max_chars: int = 4000


@dataclass(frozen=True)
class Config:
    root: str = ""
    imports: Import = field(default_factory=Import)
    quality: Quality = field(default_factory=Quality)
    repair: Repair = field(default_factory=Repair)
    vision: Vision = field(default_factory=Vision)
    search: Search = field(default_factory=Search)
    response: Response = field(default_factory=Response)
    chunking: Chunking = field(default_factory=Chunking)


def _apply(section, values):
    if not isinstance(values, dict):
        return section
    names = {f.name for f in fields(section)}
    return replace(section, **{k: v for k, v in values.items() if k in names})


def load(path: str | None = None, root: str | None = None) -> Config:
    """Defaults, then the file, then ``PAGEWRIGHT_ROOT``; ``PAGEWRIGHT_CONFIG`` names the file where no path is given."""
    root = os.environ.get("PAGEWRIGHT_ROOT") or root
    path = os.environ.get("PAGEWRIGHT_CONFIG") or path or (os.path.join(root, "config.toml") if root else None)
    told = {}
    if path and os.path.isfile(path):
        with open(path, "rb") as f:
            told = tomllib.load(f)
    config = Config()
    config = replace(config, **{f.name: _apply(getattr(config, f.name), told.get("import" if f.name == "imports" else f.name)) for f in fields(config) if f.name != "root"})
    return replace(config, root=root or str(told.get("root", "")))
