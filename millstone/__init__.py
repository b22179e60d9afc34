"""Millstone: full-text indexing, ranked search and corpus processing as Spark plans."""

__version__ = "0.1.0"
