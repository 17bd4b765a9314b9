"""Definitions, imports and references from source text, one extractor a language."""

from .run import extract

__all__ = ["extract"]
