"""Writing to paths and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from ..operators.dml import replace_table
from .readers import format_of

MODES = ("error", "errorifexists", "overwrite", "append", "ignore")


def _mode(mode: str | None) -> str:
    if mode is not None and mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    return mode or "error"


def save(frame: DataFrame, path: str, format: str | None = None, mode: str | None = None, partition_by: str | Sequence[str] = (), **options) -> None:
    """Writes a directory of part files. The format defaults to the path's ending, then to Parquet."""
    writer = frame.write.mode(_mode(mode)).format(format or format_of(path) or "parquet")
    if partition_by:
        writer = writer.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    writer.options(**{k: v for k, v in options.items() if v is not None}).save(path)


def save_as_table(frame: DataFrame, name: str, format: str | None = None, mode: str | None = None, partition_by: str | Sequence[str] = (), cluster_by: tuple[int, Sequence[str]] | None = None, **options) -> None:
    """Creates, replaces or extends a table; ``cluster_by`` is (buckets, columns), for joins without a shuffle."""
    if _mode(mode) == "append" and frame.sparkSession.catalog.tableExists(name):
        insert_into(frame, name)
        return
    writer = frame.write.mode(_mode(mode)).options(**options)
    if format:
        writer = writer.format(format)
    if partition_by:
        writer = writer.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if cluster_by:
        writer = writer.bucketBy(cluster_by[0], *cluster_by[1]).sortBy(*cluster_by[1])
    writer.saveAsTable(name)


def by_name(frame: DataFrame, table: str) -> DataFrame:
    """The frame's columns in a table's order; a missing or surplus column is an error."""
    wanted = frame.sparkSession.table(table).columns
    own = {c.lower(): c for c in frame.columns}
    if sorted(own) != sorted(c.lower() for c in wanted):
        raise ValueError(f"columns {frame.columns} are not those of {table}: {wanted}")
    return frame.select(*(frame[own[c.lower()]].alias(c) for c in wanted))


def insert_into(frame: DataFrame, table: str, overwrite: bool = False, named: bool = False) -> None:
    """Appends to a table or replaces its rows, by position or by column name."""
    (by_name(frame, table) if named else frame).write.insertInto(table, overwrite)


def replace_where(frame: DataFrame, table: str, condition: str | Column) -> None:
    """Replaces the rows of a table for which the condition holds by the frame's rows."""
    from ..operators.dml import deleted

    spark = frame.sparkSession
    replace_table(spark, table, deleted(spark.table(table), condition).unionByName(by_name(frame, table)))
