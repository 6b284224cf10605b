"""Named queries over the project's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import pkgutil
from importlib import import_module


def _modules() -> list:
    """Every module of this package that names queries, found by looking: a new module needs no registration."""
    found = [import_module(f"{__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name)]
    return [m for m in found if hasattr(m, "QUERIES")]


def all_queries() -> dict:
    """Query name to ``(spark, sf_dir) -> DataFrame``; a name that two modules use is an error."""
    out: dict = {}
    for module in _modules():
        if twice := out.keys() & module.QUERIES.keys():
            raise ValueError(f"{module.__name__} repeats {sorted(twice)}")
        out |= module.QUERIES
    return out


def all_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {k: v for m in _modules() for k, v in m.SQL.items()}
