"""Queries over the given tables, each with an independent SQL statement to compare with."""

from importlib import import_module

from .base import ORACLES, QUERIES

for _part in ("urls", "tree", "graph", "exports", "live"):
    import_module(f".{_part}", __name__)

__all__ = ["ORACLES", "QUERIES"]
