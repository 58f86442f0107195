"""Registered queries over the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType

SECTIONS = ("preparation", "checks", "feature_queries", "forecast_queries", "evaluation_queries", "monitoring_queries", "exploration_queries")


def load() -> ModuleType:
    """The registry with all sections imported."""
    for section in SECTIONS:
        import_module(f"larderflow.catalog.{section}")
    return import_module("larderflow.catalog.registry")
