"""What a physical plan says about pruning, pushed filters and shuffles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def executed(frame: DataFrame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def pushed_filters(frame: DataFrame) -> list[str]:
    """Filters that reach the scans."""
    return [x for found in re.findall(r"PushedFilters: \[([^\]]*)\]", executed(frame)) for x in re.split(r", (?![^(]*\))", found) if x]


def read_schema(frame: DataFrame) -> list[str]:
    """Columns that the scans read."""
    return [c.split(":")[0] for found in re.findall(r"ReadSchema: struct<([^>]*)>", executed(frame)) for c in found.split(",") if c]


def exchanges(frame: DataFrame) -> int:
    """Shuffles of the plan."""
    return len(re.findall(r"Exchange (?:hash|range|Round|Single)\w*", executed(frame)))
