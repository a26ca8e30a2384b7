"""Row-level operators: deterministic deduplication, top rows of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh(frame: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def first_of_each(frame: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in an order; ties are broken by all other columns that can be ordered, so runs agree."""
    rank = fresh(frame, "rank")
    rest = [F.col(f.name) for f in frame.schema if f.name not in keys and f.dataType.typeName() not in ("map", "variant")]
    window = Window.partitionBy(*keys).orderBy(*order, *rest)
    return frame.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n).drop(rank)
