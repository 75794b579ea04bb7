"""The registered queries, by area. register() imports the modules that hold them."""

from __future__ import annotations

import importlib

AREAS: list[str] = ["cleaning", "dedup", "search", "rails", "memory", "metrics", "lifecycle", "graph", "chunks", "sketches", "streams"]


def register() -> None:
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
