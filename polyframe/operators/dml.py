"""UPDATE, DELETE and MERGE as rewrites of tables or partitions, for sources without row-level operations.

The rewrites are DataFrames; ``Table`` wraps them as lazy statements that replace a catalog table
through a staging table, so that no failed write loses rows.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Most partitions that an update or delete rewrites one by one; their keys go through the driver.
PARTITIONS = 1000
OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"

Condition = str | Column | bool | Sequence[str | Column] | None
Values = Mapping[str | Column, object]


def condition_of(condition: Condition) -> Column:
    """One Column from a Column, an SQL string, a bool, or a list of them, which must all hold."""
    if condition is None:
        return F.lit(True)
    if isinstance(condition, bool):
        return F.lit(condition)
    if isinstance(condition, str):
        return F.expr(condition)
    if isinstance(condition, Column):
        return condition
    out = F.lit(True)
    for part in condition:
        out = out & condition_of(part)
    return out


def holds(condition: Condition) -> Column:
    """The condition, NULL counting as false."""
    return F.coalesce(condition_of(condition), F.lit(False))


def _value(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _named(frame: DataFrame, values: Values) -> dict[str, Column]:
    """Values by column name of the frame; names compare without case, a qualifier is dropped."""
    known = {c.lower(): c for c in frame.columns}
    out = {}
    for key, value in values.items():
        name = (key if isinstance(key, str) else _name_of(key)).split(".")[-1].strip("`")
        if name.lower() not in known:
            raise ValueError(f"{name} is no column of the table: {frame.columns}")
        out[known[name.lower()]] = _value(value)
    return out


def _name_of(column: Column) -> str:
    return str(column).removeprefix("Column<'").removesuffix("'>")


def updated(frame: DataFrame, set_: Values, where: Condition = None) -> DataFrame:
    """Rows with new values where the condition holds; right-hand sides see the old row."""
    if where is None:
        warnings.warn("an update without a condition changes every row", stacklevel=2)
    hit = holds(where)
    new = _named(frame, set_)
    return frame.select(*(F.when(hit, new[f.name]).otherwise(frame[f.name]).cast(f.dataType).alias(f.name) if f.name in new else frame[f.name] for f in frame.schema))


def deleted(frame: DataFrame, where: Condition = None) -> DataFrame:
    """Rows for which the condition is not true."""
    if where is None:
        warnings.warn("a delete without a condition removes every row", stacklevel=2)
    return frame.where(~holds(where))


@dataclass
class Clause:
    """What a merge does with a row: ``state`` is matched, source (unmatched source) or target (unmatched target)."""

    state: str
    condition: Condition = None
    action: str = ""
    values: Values | None = field(default=None)

    def _as(self, action: str, values: Values | None = None) -> Clause:
        if self.action:
            raise ValueError("a clause has one action")
        return Clause(self.state, self.condition, action, values)


class WhenMatched(Clause):
    def __init__(self, condition: Condition = None):
        super().__init__("matched", condition)

    def update(self, set_: Values) -> Clause:
        return self._as("update", set_)

    def update_all(self) -> Clause:
        return self._as("update")

    def delete(self) -> Clause:
        return self._as("delete")


class WhenNotMatched(Clause):
    def __init__(self, condition: Condition = None):
        super().__init__("source", condition)

    def insert(self, values: Values) -> Clause:
        return self._as("insert", values)

    def insert_all(self) -> Clause:
        return self._as("insert")


class WhenNotMatchedBySource(Clause):
    def __init__(self, condition: Condition = None):
        super().__init__("target", condition)

    def update(self, set_: Values) -> Clause:
        return self._as("update", set_)

    def delete(self) -> Clause:
        return self._as("delete")


def _joined(target: DataFrame, source: DataFrame, condition: Condition) -> DataFrame:
    left = target.withColumn("__target", F.monotonically_increasing_id())
    right = source.withColumn("__source", F.lit(True))
    return left.join(right, condition_of(condition), "full_outer")


def ambiguous(target: DataFrame, source: DataFrame, condition: Condition) -> bool:
    """Whether a target row matches several source rows."""
    left = target.withColumn("__target", F.monotonically_increasing_id())
    pairs = left.join(source, condition_of(condition)).select("__target")
    return not pairs.groupBy("__target").count().where("count > 1").isEmpty()


def merged(target: DataFrame, source: DataFrame, condition: Condition, clauses: Sequence[Clause]) -> DataFrame:
    """The table after a merge, by one full outer join.

    For each row the first clause of its state whose condition is true wins. Target rows without a
    winner stay, source rows without one are left out. That no target row matches several source
    rows is for the caller to check (``ambiguous``); ``Table.merge`` does.
    """
    if not clauses or not all(c.action for c in clauses):
        raise ValueError("a merge needs clauses, each with an action")
    both = _joined(target, source, condition)
    has_target, has_source = F.col("__target").isNotNull(), F.col("__source").isNotNull()
    state = {"matched": has_target & has_source, "source": ~has_target, "target": ~has_source}
    winner = F.lit(None).cast("int")
    for k, clause in reversed(list(enumerate(clauses))):
        winner = F.when(state[clause.state] & holds(clause.condition), k).otherwise(winner)
    given = []
    for clause in clauses:
        if clause.action == "delete":
            given.append({})
        elif clause.values is not None:
            given.append(_named(target, clause.values))
        else:
            own = {c.lower(): c for c in source.columns}
            given.append({c: source[own[c.lower()]] for c in target.columns if c.lower() in own})
    columns = []
    for f in target.schema:
        value = target[f.name]
        for k, clause in enumerate(clauses):
            if f.name in given[k]:
                value = F.when(F.col("__winner") == k, given[k][f.name].cast(f.dataType)).otherwise(value)
        columns.append(value.cast(f.dataType).alias(f.name))
    deletes = [k for k, c in enumerate(clauses) if c.action == "delete"]
    chosen = both.withColumn("__winner", winner)
    kept = (has_target | F.col("__winner").isNotNull()) & ~F.coalesce(F.col("__winner").isin(deletes) if deletes else F.lit(False), F.lit(False))
    return chosen.where(kept).select(*columns)


class ReplaceFailed(RuntimeError):
    """A table could not be overwritten; ``staging`` names the table that holds all rows to be written."""

    def __init__(self, name: str, staging: str):
        super().__init__(f"overwriting {name} failed, its state is unknown; all rows to be written stand in {staging}: insert them from there, then drop it")
        self.name, self.staging = name, staging


def replace_table(spark: SparkSession, name: str, frame: DataFrame, mode: str = "static") -> int:
    """Replaces a catalog table's rows; returns the number written, counted by the write itself.

    In ``dynamic`` mode only the partitions that the new rows are in are replaced.

    The new rows are written to a staging table first: if that fails, the table is as it was and
    nothing is left behind. The staging table is dropped only after the table has been overwritten;
    if overwriting fails, it stays, and ``ReplaceFailed`` names it.
    """
    staging = f"{name}__{uuid.uuid4().hex[:12]}"
    counted = Observation(staging)
    try:
        frame.observe(counted, F.count(F.lit(1)).alias("rows")).write.saveAsTable(staging)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {staging}")
        raise
    before = spark.conf.get(OVERWRITE_MODE)
    try:
        spark.conf.set(OVERWRITE_MODE, mode)
        spark.table(staging).write.insertInto(name, overwrite=True)
    except BaseException as error:
        raise ReplaceFailed(name, staging) from error
    finally:
        spark.conf.set(OVERWRITE_MODE, before)
    spark.sql(f"DROP TABLE IF EXISTS {staging}")
    spark.catalog.refreshTable(name)
    return counted.get["rows"]


def touched(table: DataFrame, parts: Sequence[str], where: Condition, deletes: bool) -> Column | None:
    """The condition that selects the partitions with a row for which ``where`` holds.

    None if they cannot be rewritten one by one: there are more than ``PARTITIONS``, a key is null,
    or a delete would empty one, which then has no new rows to replace it.
    """
    counts = table.groupBy(*parts).agg(F.count(F.lit(1)).alias("__rows"), F.count_if(holds(where)).alias("__held"))
    found = counts.where("__held > 0").limit(PARTITIONS + 1).collect()
    if len(found) > PARTITIONS or any((deletes and r["__rows"] == r["__held"]) or None in [r[p] for p in parts] for r in found):
        return None
    out = F.lit(False)
    for row in found:
        out = out | reduce(and_, (F.col(p) == F.lit(row[p]).cast(table.schema[p].dataType) for p in parts))
    return out


@dataclass(frozen=True)
class Statement:
    """A statement that is not yet executed: ``frame`` is the table after it.

    ``prune`` gives the rows to write where some partitions will do, or None.
    """

    spark: SparkSession
    name: str
    frame: DataFrame
    check: Callable[[], None] = lambda: None
    prune: Callable[[], DataFrame | None] = lambda: None

    def execute(self) -> int:
        """Runs it; returns the number of rows of the table afterwards."""
        self.check()
        some = self.prune()
        if some is None:
            return replace_table(self.spark, self.name, self.frame)
        if not some.isEmpty():
            replace_table(self.spark, self.name, some, "dynamic")
        return self.spark.table(self.name).count()


class Table:
    """A catalog table with row-level statements."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.frame = spark.table(name)

    def __getattr__(self, name: str):
        return getattr(self.frame, name)

    def __getitem__(self, name: str) -> Column:
        return self.frame[name]

    def alias(self, name: str) -> Table:
        out = Table.__new__(Table)
        out.spark, out.name, out.frame = self.spark, self.name, self.frame.alias(name)
        return out

    def _pruned(self, where: Condition, kept: Sequence[str], deletes: bool, rewritten: Callable[[DataFrame], DataFrame]) -> Callable[[], DataFrame | None]:
        def prune() -> DataFrame | None:
            parts = [c.name for c in self.spark.catalog.listColumns(self.name) if c.isPartition]
            if not parts or where is None or not set(parts) <= set(kept):
                return None
            some = touched(self.frame, parts, where, deletes)
            return None if some is None else rewritten(self.frame.where(some))

        return prune

    def update(self, set_: Values, where: Condition = None) -> Statement:
        kept = [c for c in self.frame.columns if c not in _named(self.frame, set_)]
        return Statement(self.spark, self.name, updated(self.frame, set_, where), prune=self._pruned(where, kept, False, lambda f: updated(f, set_, where)))

    def delete(self, where: Condition = None) -> Statement:
        return Statement(self.spark, self.name, deleted(self.frame, where), prune=self._pruned(where, self.frame.columns, True, lambda f: deleted(f, where)))

    def merge(self, source: DataFrame, condition: Condition, clauses: Sequence[Clause]) -> Statement:
        def check() -> None:
            if any(c.state == "matched" for c in clauses) and ambiguous(self.frame, source, condition):
                raise ValueError("a row of the target matches several rows of the source")

        return Statement(self.spark, self.name, merged(self.frame, source, condition, clauses), check)
