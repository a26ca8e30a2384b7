"""Registration of queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import load
from .deferred import Expr, force

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder as attributes: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)

    def views(self, *names: str) -> SparkSession:
        for name in names:
            load(self.spark, self.folder, name).createOrReplaceTempView(name)
        return self.spark


def query(oracle: str | None = None, name: str | None = None) -> Callable:
    """Registers a function of ``Tables`` under its name."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or function.__name__
        QUERIES[key] = lambda spark, folder: function(Tables(spark, folder))
        if oracle:
            ORACLES[key] = oracle
        return function

    return register


def family(name: str, table: str, keys: str, columns: dict[str, tuple[Expr, str]], where: str | None = None, groups: str | None = None) -> None:
    """Registers a query of one expression a column: alias -> (Spark column, SQL).

    With ``groups`` the expressions are aggregates of these keys; else the keys are kept beside them.
    """
    own = [k.strip() for k in keys.split(",") if k.strip()]

    def run(t: Tables) -> DataFrame:
        frame = getattr(t, table)
        frame = frame.where(where) if where else frame
        cells = [force(c).alias(a) for a, (c, _) in columns.items()]
        if groups is None:
            return frame.select(*own, *cells)
        return frame.groupBy(*own).agg(*cells) if own else frame.agg(*cells)

    cells = ", ".join([*own, *(f"{sql} AS {a}" for a, (_, sql) in columns.items())])
    tail = (f" WHERE {where}" if where else "") + (f" GROUP BY {', '.join(own)}" if groups is not None and own else "")
    QUERIES[name] = lambda spark, folder: run(Tables(spark, folder))
    ORACLES[name] = f"SELECT {cells} FROM {table}{tail}"
