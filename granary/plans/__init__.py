"""Runnable queries over the test tables, each with an equivalent SQL text."""

from importlib import import_module

MODULES = ("tables", "cleaning", "scalars", "features", "labels", "splits", "panel", "aggregates",
           "metrics", "models", "ledger", "streams")


def load_all() -> None:
    for name in MODULES:
        try:
            import_module(f"granary.plans.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"granary.plans.{name}":
                raise
