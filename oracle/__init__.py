"""DuckDB texts that define the expected rows of each query."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["stats", "interactions", "features", "recall", "evaluation", "search", "documents", "streaming"]


def texts() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in _MODULES:
        out.update(import_module(f"oracle.{name}").SQL)
    return out
