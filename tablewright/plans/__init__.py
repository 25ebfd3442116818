"""Registered queries, each next to the SQL that checks it."""

from importlib import import_module

from tablewright.plans.registry import ORACLES, QUERIES

MODULES = [
    "scans", "roles", "profiling", "columns", "lookups", "statistics", "ordering",
    "preparation", "text", "scalars", "submissions", "grading", "telemetry", "learning", "streams",
]


def load():
    """Import every plan module once and return (queries, oracle SQL)."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
