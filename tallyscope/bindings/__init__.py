"""Operators bound to the benchmark tables, each beside its SQL twin."""

from __future__ import annotations

import importlib
import pkgutil

from .base import REGISTRY, Query, Tables

__all__ = ["Query", "Tables", "load"]


def load() -> dict[str, Query]:
    """All registered queries, in name order."""
    for mod in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{mod.name}")
    return dict(sorted(REGISTRY.items()))
