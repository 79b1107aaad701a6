"""Import every query module; the dictionaries below are then complete."""

from __future__ import annotations

from importlib import import_module

from lamina.llm.registry import ORACLES, QUERIES

MODULES = ("queries_text", "queries_vectors", "queries_web", "queries_dedup", "queries_conversations")

for _name in MODULES:
    import_module(f"lamina.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]
