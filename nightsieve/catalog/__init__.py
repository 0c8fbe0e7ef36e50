"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ["frames", "files", "pixels", "stars", "live"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"nightsieve.catalog.{name}_queries")


def queries() -> dict:
    from nightsieve.catalog import registry

    _load()
    return dict(registry.QUERIES)


def checks() -> dict:
    from nightsieve.catalog import registry

    _load()
    return dict(registry.CHECKS)
