"""Settings: where the index is. From a YAML-like file of `key: value` lines, overridden by arguments."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path


def _path(value: str | Path) -> Path:
    return Path(value).expanduser().resolve()


@dataclass
class Settings:
    db_path: Path = field(default_factory=lambda: Path("index.db"))
    repo_path: Path = field(default_factory=lambda: Path("."))

    def __post_init__(self):
        self.db_path, self.repo_path = _path(self.db_path), _path(self.repo_path)


def load(config: str | Path | None = None, **overrides: str | Path | None) -> Settings:
    """Settings of a file (defaults if it isn't there); arguments that aren't None win."""
    values: dict[str, str | Path] = {}
    if config and Path(config).exists():
        for line in Path(config).read_text().splitlines():
            key, colon, value = line.split(" #")[0].partition(":")
            if colon and not key.lstrip().startswith("#") and value.strip():
                values[key.strip()] = value.strip().strip("'\"")
    values |= {k: v for k, v in overrides.items() if v is not None}
    return Settings(**{k: v for k, v in values.items() if k in ("db_path", "repo_path")})
