"""Registered queries with their SQL, by area."""

from __future__ import annotations

import importlib
from types import ModuleType

FLAGSHIP = "hybrid_retrieve"
_AREAS = ("problems", "usage", "texts", "search", "library", "dialogue", "streams", "records")


def modules() -> list[ModuleType]:
    """The modules that hold QUERIES and SQL."""
    return [importlib.import_module(f"{__name__}.{area}") for area in _AREAS]
