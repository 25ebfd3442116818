"""Query registry: a Spark callable and, where SQL can say the same, its check."""

from __future__ import annotations

from collections.abc import Callable

from tablewright.sources.views import VIEW_SQL, Tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
MODULE_OF: dict[str, str] = {}


def with_views(body: str, *views: str) -> str:
    """Prefix a SELECT (or further CTEs starting with a name) with the views it uses."""
    ctes = ", ".join(f"{v} AS ({VIEW_SQL[v]})" for v in views)
    text = body.strip()
    if text.lower().startswith("with "):
        return f"WITH {ctes}, {text[5:]}" if ctes else text
    return f"WITH {ctes} {text}" if ctes else text


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        MODULE_OF[name] = fn.__module__.rsplit(".", 1)[1]
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return register
