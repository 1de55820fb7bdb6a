"""Configuration and keys; they are read on the driver and never put into a table."""

from __future__ import annotations

import tomllib
from pathlib import Path

PLACEHOLDER = "<"


def load_config(path: str | Path) -> dict:
    """A TOML file without unfilled placeholders."""
    config = tomllib.loads(Path(path).read_text())

    def walk(value, where):
        if isinstance(value, dict):
            for k, v in value.items():
                walk(v, f"{where}.{k}")
        elif isinstance(value, str) and value.startswith(PLACEHOLDER) and value.endswith(">"):
            raise ValueError(f"fill in {where.lstrip('.')}")

    walk(config, "")
    return config


def load_key(path: str | Path, name: str) -> str:
    """The value of one NAME=value line."""
    for line in Path(path).read_text().splitlines():
        key, sign, value = line.strip().partition("=")
        if sign and key.strip() == name:
            return value.strip().strip("\"'")
    raise KeyError(name)


def allowed_models(names: list[str], prefixes: tuple[str, ...], denied: tuple[str, ...]) -> list[str]:
    """A catalogue's names that begin with one of the prefixes and hold none of the denied words."""
    return sorted(n for n in names if n.startswith(prefixes) and not any(d in n for d in denied))
