"""Options, provenance and parameter checks."""

from __future__ import annotations

import datetime as dt
import math
import os
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path

from skyobs import __version__


class SkyobsWarning(UserWarning):
    """Something in the data was handled in a way the caller should know of."""


def warn(message: str) -> None:
    warnings.warn(message, SkyobsWarning, stacklevel=3)


@dataclass(frozen=True)
class Options:
    """Session-wide defaults."""

    catalog: str = "element84"
    grid_res: float = 25_000
    grid_crs: int = 6933
    chunk_pixels: float = 4e6
    workers: int = 1
    cache_dir: str | None = None
    timeout: float = 60
    max_page: int = 500
    verbose: bool = True


_current = Options()


def options(**changes) -> Options:
    """The options in force; with arguments, set them and return the former ones."""
    global _current
    before = _current
    if changes:
        _current = replace(_current, **changes)
    return before


def cache_dir(create: bool = True) -> Path:
    """Option, then SKYOBS_CACHE, then XDG_CACHE_HOME, then ~/.cache."""
    named = _current.cache_dir or os.environ.get("SKYOBS_CACHE")
    path = Path(named) if named else Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "skyobs"
    if create:
        path.mkdir(parents=True, exist_ok=True)
    return path


@dataclass(frozen=True)
class Manifest:
    """Where a table came from: versions, time and free entries, kept beside a DataFrame."""

    entries: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def create(cls, **entries) -> Manifest:
        from pyspark import __version__ as spark_version

        base = {"skyobs_version": __version__, "spark_version": spark_version, "created": dt.datetime.now(dt.UTC).isoformat(timespec="seconds")}
        return cls(base | {k: str(v) for k, v in entries.items()})

    def with_entries(self, **entries) -> Manifest:
        return Manifest(dict(self.entries) | {k: str(v) for k, v in entries.items()})

    def text(self) -> str:
        return "".join(f"{k}: {v}\n" for k, v in self.entries.items())


def number(value: float, name: str, lower: float = -math.inf, upper: float = math.inf) -> float:
    """value, if it is a finite number within the bounds."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or not lower <= value <= upper:
        raise ValueError(f"{name} must be a number from {lower} to {upper}, not {value!r}")
    return float(value)


def fraction(value: float, name: str) -> float:
    return number(value, name, 0, 1)


def choice(value: str, name: str, allowed) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(map(str, allowed))}, not {value!r}")
    return value
