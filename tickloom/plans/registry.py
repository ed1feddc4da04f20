"""Query registry: name -> (Spark callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def load() -> dict[str, tuple[Callable, str | None]]:
    import importlib
    import pkgutil

    import tickloom.plans as here

    for m in sorted(pkgutil.iter_modules(here.__path__), key=lambda m: m.name):
        if m.name.startswith("queries_"):
            importlib.import_module(f"tickloom.plans.{m.name}")
    return REGISTRY
