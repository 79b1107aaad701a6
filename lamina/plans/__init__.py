"""Registered queries over the shared parquet tables."""

from importlib import import_module

MODULES = ("scoring", "catalog", "channels", "reports", "edits", "wide")


def load_all() -> None:
    for name in MODULES:
        import_module(f"lamina.plans.{name}")
