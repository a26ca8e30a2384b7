"""Frame comparison for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.testing import assertDataFrameEqual, assertSchemaEqual

__all__ = ["assertDataFrameEqual", "assertSchemaEqual", "rows"]


def rows(frame: DataFrame) -> list[tuple]:
    """Rows as tuples in a stable order."""
    return sorted((tuple(r) for r in frame.collect()), key=str)
