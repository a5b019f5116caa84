"""Readers and writers of the library's tables."""

from keyloom.sources.tables import read_table

__all__ = ["read_table"]
