"""Registered queries over the test tables, each with its SQL where SQL can say it."""

from importlib import import_module

from .base import QUERIES, SQL

_MODULES = (
    "scans", "cleaning", "joining", "counting", "windows", "samples", "sets", "masking", "texts", "messages", "maps", "checks", "profiles",
    "validation", "streams", "extensions",
)


def load() -> tuple[dict, dict]:
    for name in _MODULES:
        import_module(f".{name}", __name__)
    return QUERIES, SQL
