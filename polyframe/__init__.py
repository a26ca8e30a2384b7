"""polyframe: relational and data-processing operators written directly on Apache Spark."""

from .operators.dml import Statement, Table, WhenMatched, WhenNotMatched, WhenNotMatchedBySource
from .plans import lineage
from .session import session
from .sources import load, read, save, save_as_table

__all__ = ["Statement", "Table", "WhenMatched", "WhenNotMatched", "WhenNotMatchedBySource", "lineage", "load", "read", "save", "save_as_table", "session"]
