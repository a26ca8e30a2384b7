"""Aggregation helpers: grouping sets, pivots with checked values, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most distinct values that a pivot without given values may make columns of.
PIVOT_VALUES = 10_000


def grouping_sets(frame: DataFrame, sets: Sequence[Sequence[str]], *aggregates: Column) -> DataFrame:
    """Aggregates for each of the given sets of keys."""
    keys = list(dict.fromkeys(k for own in sets for k in own))
    return frame.groupingSets([[F.col(k) for k in own] for own in sets], *map(F.col, keys)).agg(*aggregates)


def pivot(frame: DataFrame, keys: Sequence[str], column: str, aggregates: Sequence[Column], values: Sequence | None = None) -> DataFrame:
    """A pivot; without ``values`` the distinct ones are read first, in order, up to a checked number."""
    if values is None:
        found = frame.select(column).distinct().orderBy(column).limit(PIVOT_VALUES + 1).collect()
        if len(found) > PIVOT_VALUES:
            raise ValueError(f"{column} has more than {PIVOT_VALUES} values; give those to pivot")
        values = [r[0] for r in found if r[0] is not None]
    return frame.groupBy(*keys).pivot(column, list(values)).agg(*aggregates)


def quantiles(frame: DataFrame, columns: str | Sequence[str], probabilities: Sequence[float], error: float = 0.0) -> list:
    """Approximate quantiles: a flat list for one column, a list of lists for several."""
    return frame.approxQuantile(columns if isinstance(columns, str) else list(columns), list(probabilities), error)


def correlation(frame: DataFrame, a: str, b: str) -> float:
    return frame.stat.corr(a, b)


def covariance(frame: DataFrame, a: str, b: str) -> float:
    return frame.stat.cov(a, b)
