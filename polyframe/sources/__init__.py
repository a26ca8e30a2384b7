"""Readers and writers."""

from .readers import FORMATS, format_of, load, read, tables
from .writers import by_name, insert_into, replace_where, save, save_as_table

__all__ = ["FORMATS", "by_name", "format_of", "insert_into", "load", "read", "replace_where", "save", "save_as_table", "tables"]
