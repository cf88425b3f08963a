"""Configuration of a scan: frozen dataclasses, found, read and checked on the driver."""

from __future__ import annotations

import dataclasses
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

FILE_NAME = ".loquat.yml"
#: A directory holding one of these is a project's root: the search for a file goes no further up.
ANCHORS = ("Package.swift", ".git")


class ConfigError(ValueError):
    """A configuration that cannot be read or does not hold."""


@dataclass(frozen=True)
class Output:
    path: str = "Sources/Generated/i18n.swift"
    enum_name: str = "i18n"
    table_name: str = "Localizable"
    merge_strategy: str = "overwrite"


@dataclass(frozen=True)
class Assets:
    enabled: bool = False
    path: str = "Sources/Generated/Assets.swift"
    enum_name: str = "Assets"
    use_image_resource: bool = False


@dataclass(frozen=True)
class ExistingLocalization:
    patterns: tuple[str, ...] = ()
    exclude_arguments_of: tuple[str, ...] = ()


@dataclass(frozen=True)
class StringCatalog:
    validate_missing: bool = True
    validate_orphaned: bool = False


@dataclass(frozen=True)
class StringDiscovery:
    static_constants: bool = True
    indirect_argument_hints: bool = True


@dataclass(frozen=True)
class Config:
    sources: tuple[str, ...] = ("Sources",)
    minimum_confidence: float = 0.85
    exclude: tuple[str, ...] = ()
    incremental: bool = False
    namespace_strategy: str = "file"
    migration: str = "audit"
    accessibility_audit: bool = False
    ignore_marker: str = "loquat:ignore"
    output: Output = field(default_factory=Output)
    assets: Assets = field(default_factory=Assets)
    existing_localization: ExistingLocalization = field(default_factory=ExistingLocalization)
    string_catalog: StringCatalog = field(default_factory=StringCatalog)
    string_discovery: StringDiscovery = field(default_factory=StringDiscovery)


def _built(kind, values):
    known = {f.name: f for f in dataclasses.fields(kind)}
    out = {}
    for name, value in (values or {}).items():
        if name not in known:
            continue
        default = getattr(kind(), name)
        if dataclasses.is_dataclass(default):
            value = _built(type(default), value)
        elif isinstance(default, tuple):
            value = tuple(value)
        elif name in ("migration", "accessibility_audit") and isinstance(value, dict):
            value = value.get("mode" if name == "migration" else "enabled", default)
        elif isinstance(default, float):
            value = float(value)
        elif type(value) is not type(default):
            raise ConfigError(f"{name}: expected {type(default).__name__}, got {value!r}")
        out[name] = value
    return kind(**out)


def load(text: str) -> Config:
    """A YAML text; missing keys have their defaults, unknown ones are ignored."""
    import yaml

    try:
        return _built(Config, yaml.safe_load(text))
    except ConfigError:
        raise
    except Exception as problem:
        raise ConfigError(f"Failed to parse {FILE_NAME}: {problem}") from problem


def discover(start: str | os.PathLike, home: str | os.PathLike | None = None) -> Path | None:
    """The nearest file at or above ``start``, not above a project's root or the home directory."""
    current, home = Path(start).resolve(), Path(home or Path.home()).resolve()
    while True:
        if (current / FILE_NAME).is_file():
            return current / FILE_NAME
        if any((current / x).exists() for x in ANCHORS) or current in (home, current.parent):
            return None
        current = current.parent


def is_identifier(name: str) -> bool:
    return re.fullmatch(r"[^\W\d]\w*", name) is not None


def validate(config: Config, base: str | os.PathLike) -> None:
    if not 0 <= config.minimum_confidence <= 1:
        raise ConfigError(f"minimum_confidence must be between 0.0 and 1.0, got {config.minimum_confidence}")
    for where, name in (("output", config.output.enum_name), ("assets", config.assets.enum_name)):
        if not is_identifier(name):
            raise ConfigError(f"{where}.enum_name '{name}' is not a valid Swift identifier")
    for source in config.sources:
        if not (Path(base) / source).exists():
            raise ConfigError(f"Source path does not exist: {source}")
