"""Settings: TOML files, lookup, validation, merging, presets."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

NAMES = ("cairnlight.toml", "cairnlight-config.toml", ".cairnlight.toml")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    include_docs: bool = True
    include_private: bool = False
    parse_dependencies: bool = False
    max_file_size: int = 10 * 1024 * 1024
    output_format: str = "json"
    pretty: bool = True
    include: tuple[str, ...] = ("src/**/*.rs",)
    exclude: tuple[str, ...] = ("target/**", "tests/**")
    plugins: tuple[str, ...] = ()

    def validate(self) -> Config:
        if not 0 < self.max_file_size <= 100 * 1024 * 1024:
            raise ConfigError("max_file_size must be over 0 and at most 100 MB")
        if not self.include:
            raise ConfigError("include must not be empty")
        both = sorted(set(self.include) & set(self.exclude))
        if both:
            raise ConfigError(f"patterns both included and excluded: {', '.join(both)}")
        return self

    def merged(self, other: dict) -> Config:
        """This configuration with the settings that ``other`` has."""
        known = {f.name for f in fields(self)}
        unknown = sorted(set(other) - known)
        if unknown:
            raise ConfigError(f"unknown settings: {', '.join(unknown)}")
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in other.items() if v is not None})

    def to_toml(self) -> str:
        def show(v):
            if isinstance(v, bool):
                return str(v).lower()
            if isinstance(v, tuple):
                return "[" + ", ".join(show(x) for x in v) + "]"
            return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(v, str) else str(v)

        return "".join(f"{k} = {show(v)}\n" for k, v in asdict(self).items())


PRESETS = {
    "documentation": {"include_docs": True, "include_private": False, "output_format": "markdown"},
    "analysis": {"include_docs": True, "include_private": True, "parse_dependencies": True, "output_format": "json"},
    "training": {"include_docs": True, "include_private": False, "output_format": "rag", "pretty": False},
    "testing": {"include_docs": False, "include_private": True, "exclude": ["target/**"]},
}


def parse(content: str) -> Config:
    try:
        return Config().merged(tomllib.loads(content)).validate()
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e


def load(path: str | Path) -> Config:
    return parse(Path(path).read_text())


def find(*folders: str | Path) -> Config:
    """The first configuration file of the folders, else the defaults."""
    for folder in folders or (".", Path.home() / ".config" / "cairnlight"):
        for name in NAMES:
            if (at := Path(folder) / name).is_file():
                return load(at)
    return Config()
