"""All functions of ``pyspark.sql.functions``, some under further parameter names, and three more.

Where a name below takes other parameters than Spark's function, it accepts both spellings.
"""

from __future__ import annotations

import datetime as _datetime
from collections.abc import Mapping as _Mapping
from functools import wraps as _wraps

from pyspark import SparkContext as _SparkContext
from pyspark.sql import Column as _Column
from pyspark.sql import Row as _Row
from pyspark.sql import functions as _F

# The older names too, which a star import leaves out.
globals().update({name: value for name, value in vars(_F).items() if not name.startswith("_") and callable(value)})


def lit(value=None):
    """A literal; besides what Spark takes, mappings become maps, tuples and rows structs, sets arrays."""
    if isinstance(value, _Column):
        return value
    if isinstance(value, _Row):
        return _F.struct(*(lit(v).alias(k) for k, v in value.asDict().items()))
    if isinstance(value, _Mapping):
        return _F.create_map(*(lit(x) for pair in value.items() for x in pair))
    if isinstance(value, tuple):
        return _F.struct(*(lit(v).alias(f"_{k}") for k, v in enumerate(value, 1)))
    if isinstance(value, (list, set, frozenset)):
        return _F.array(*map(lit, value))
    if isinstance(value, _datetime.datetime) and value.tzinfo is None:
        return _F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return _F.lit(value)


def array_reverse(col):
    """The elements in reverse order."""
    return _F.reverse(col)


def to_str(value):
    """A Python value as the text that reader and writer options take; None stays None."""
    if value is None:
        return None
    return str(value).lower() if isinstance(value, bool) else str(value)


def get_active_spark_context():
    """The context of the running application."""
    context = _SparkContext._active_spark_context
    if context is None:
        raise RuntimeError("no Spark application is running")
    return context


def regexp_replace(str, pattern, replacement, position=None):
    """``regexp_replace`` that leaves what stands before a 1-based position as it is."""
    column = _F.col(str) if not isinstance(str, _Column) else str
    if position is None:
        return _F.regexp_replace(column, pattern, replacement)
    rest = _F.regexp_replace(_F.substring(column, position, 2**31 - 1), pattern, replacement)
    return _F.concat(_F.substring(column, 1, position - 1), rest)


def _dated(function):
    """Adds ``cast_as_date``: False keeps a timestamp's time of day."""

    @_wraps(function)
    def made(col, number, cast_as_date=True):
        out = function(col, number)
        if cast_as_date:
            return out
        column = _F.col(col) if not isinstance(col, _Column) else col
        by = _F.lit(number) if not isinstance(number, (_Column, str)) else (_F.col(number) if isinstance(number, str) else number)
        if function is _F.add_months:
            return _F.timestamp_add("MONTH", by, column)
        return _F.timestamp_add("DAY", by if function is _F.date_add else -by, column)

    return made


date_add, date_sub, add_months = map(_dated, (_F.date_add, _F.date_sub, _F.add_months))
dateadd = date_add


def _spelled(name, **names):
    """Spark's function, with further names for some parameters."""
    function = getattr(_F, name)

    @_wraps(function)
    def made(*args, **kwargs):
        return function(*args, **{names.get(k, k): v for k, v in kwargs.items()})

    return made


#: Function -> further parameter names and Spark's names for them.
SPELLINGS = {
    "col": {"column_name": "col"},
    "instr": {"col": "str"},
    "date_format": {"col": "date"},
    "trunc": {"col": "date"},
    "next_day": {"col": "date"},
    "last_day": {"col": "date"},
    "from_unixtime": {"col": "timestamp"},
    "to_time": {"col": "str"},
    "try_to_time": {"col": "str"},
    "array_insert": {"col": "arr"},
    "arrays_overlap": {"col1": "a1", "col2": "a2"},
    "element_at": {"value": "extraction"},
    "array_remove": {"value": "element"},
    "schema_of_json": {"col": "json"},
    "schema_of_csv": {"col": "csv"},
    "assert_true": {"errorMsg": "errMsg"},
    "raise_error": {"errorMsg": "errMsg"},
}
globals().update({name: _spelled(name, **names) for name, names in SPELLINGS.items()})
