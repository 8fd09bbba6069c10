"""All query registries of the core."""

from __future__ import annotations

import importlib

MODULES = ("core_problems", "pointwise", "sequences", "reductions", "relations", "domain", "graphs", "statistics", "datasets", "sourced", "completions")


def registries() -> list:
    return [importlib.import_module(f"{__package__}.{name}").R for name in MODULES]
