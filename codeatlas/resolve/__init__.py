"""Resolution of imports and references to definitions, as relational joins."""

from .build import build_graph

__all__ = ["build_graph"]
