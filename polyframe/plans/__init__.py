"""Looking at plans."""

from .lineage import Node, lineage
from .inspect import exchanges, pushed_filters, read_schema

__all__ = ["Node", "exchanges", "lineage", "pushed_filters", "read_schema"]
