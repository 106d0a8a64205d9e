"""Composed analyses and the registry of queries."""

from . import entities, exactness, graphs, loads, modules, names, relational, resolution, reviews, search, validation  # noqa: F401
from .registry import QUERIES
from .reviews import flagship

__all__ = ["QUERIES", "flagship"]
