"""Registered queries, by survey section."""

from __future__ import annotations

from importlib import import_module

from .base import Catalog

SECTIONS = ("sources", "predicates", "joins", "aggregates", "windows", "models", "streams", "jobs")


def everything() -> Catalog:
    out = Catalog()
    for name in SECTIONS:
        out.update(import_module(f".{name}", __package__).CATALOG)
    return out
