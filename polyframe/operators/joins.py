"""Joins beyond one call: checked broadcasts, salted joins, range and as-of joins without nested loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import fresh

#: Largest side that ``small`` broadcasts, in bytes of the optimizer's estimate.
BROADCAST_BYTES = 64 << 20
#: Bucket widths of a range join grow by this factor a level, over this many levels.
GROWTH, LEVELS = 16, 12


def estimated_bytes(frame: DataFrame) -> int:
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(frame: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint if its estimated size allows one, else as it is."""
    return F.broadcast(frame) if estimated_bytes(frame) <= most else frame


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """An equi-join whose left rows of a key are spread over ``salts`` tasks; each right row is repeated as often.

    For inner, left, left_semi and left_anti joins, whose result does not depend on where right rows stand.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how}")
    salt = fresh(left, fresh(right, "salt"))
    spread = left.withColumn(salt, F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    repeated = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*keys, salt], how).drop(salt)


def _number(frame: DataFrame, name: str) -> Column:
    """A column as a double that never falls where the column rises: days of dates, seconds of times."""
    kind, column = frame.schema[name].dataType.typeName(), F.col(name)
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind == "timestamp_ntz":  # by its parts: a cast would pass through the session's time zone
        return (F.unix_date(column.cast("date")).cast("long") * 86400 + F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)).cast("double")
    return column.cast("double")


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs with ``low <= point < high``, by an equi-join on buckets.

    ``width`` counts numbers, days of dates or seconds of times. An interval stands in the at most
    two buckets of its level that it meets: buckets of level 0 are one width wide, those of each
    further level ``GROWTH`` times as wide, and an interval takes the first level whose buckets
    are as wide as it is. So no interval is repeated more often for being long. A left row is
    looked up once for each level in use; one pass over the right side finds these, at most
    ``LEVELS`` + 1. Intervals wider than all levels, such as open-ended ones, share one bucket a key.
    Rows with a null in the point, in a bound or in a key pair with nothing.
    """
    bucket = fresh(left, fresh(right, "bucket"))
    wide = [width * GROWTH**k for k in range(LEVELS)]
    length = _number(right, high) - _number(right, low)
    level = F.lit(LEVELS)
    for k, size in reversed(list(enumerate(wide))):
        level = F.when(length <= size, k).otherwise(level)
    spans = right.where(F.col(low) < F.col(high)).dropna(subset=[low, high, *on])
    used = sorted(r[0] for r in spans.select(level.alias("level")).distinct().collect()) or [0]
    slot = lambda number, k: F.lit(0).cast("long") if k == LEVELS else F.floor(number / wide[k])
    at = lambda k, number: F.struct(F.lit(k).alias("level"), number.alias("slot"))
    on_level = lambda k: lambda number: at(k, number)  # noqa: E731  one parameter: of two, the second would be the index
    met = F.lit(None).cast("array<struct<level:int,slot:bigint>>")
    for k in used:
        slots = F.sequence(slot(_number(right, low), k), slot(_number(right, high), k))
        met = F.when(level == k, F.transform(slots, on_level(k))).otherwise(met)
    spread = spans.withColumn(bucket, F.explode(met))
    points = left.dropna(subset=[point, *on]).withColumn(bucket, F.explode(F.array(*(at(k, slot(_number(left, point), k)) for k in used))))
    pairs = points.join(spread, [*on, bucket]).drop(bucket)
    return pairs.where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high)))


def as_of_join(left: DataFrame, right: DataFrame, time: str, on: Sequence[str], values: Sequence[str], suffix: str = "_asof", width: float | None = None) -> DataFrame:
    """Each left row with the values of the last right row of its key up to its time.

    Both sides are sorted together by one window; no pair is formed. Right rows of equal time and
    key come in the order of their values. Left rows with a null time or key stay without values.
    Without ``width`` a key's rows are one task's. With it (numbers, days of dates or seconds of
    times) they are cut into slices of that width: each slice's last right row, found before the
    shuffle, is carried into the slices after it. Only the carrying sees a whole key, as one row a slice.
    """
    from pyspark.sql import Window

    keys = [f"__key{k}" for k in range(len(on))]
    part = [*keys, "__slice"]
    needed = [time, *on]

    def marked(frame: DataFrame, side: int, body: Column, latest: Column) -> DataFrame:
        cut = F.lit(0).cast("long") if width is None else F.floor(_number(frame, time) / width)
        named = [F.col(o).alias(k) for o, k in zip(on, keys, strict=True)]
        return frame.dropna(subset=needed).select(*named, cut.alias("__slice"), F.col(time).alias("__time"), F.lit(side).alias("__side"), body.alias("__left"), latest.alias("__latest"))

    seen = F.struct(*(F.col(v).alias(v) for v in values))
    kind = right.select(seen.alias("s")).schema["s"].dataType
    a = marked(left, 1, F.struct(*left.columns), F.lit(None).cast(kind))
    b = marked(right, 0, F.lit(None).cast(a.schema["__left"].dataType), seen)
    both = a.unionByName(b)
    if width is not None:
        last = F.max(F.when(F.col("__side") == 0, F.struct("__time", "__latest")))
        before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = both.groupBy(*part).agg(last.alias("__last")).withColumn("__last", F.last("__last", ignorenulls=True).over(before)).where("__last is not null")
        none = lambda c: F.lit(None).cast(both.schema[c].dataType).alias(c)
        both = both.unionByName(carried.select(*part, none("__time"), F.lit(0).alias("__side"), none("__left"), F.col("__last.__latest").alias("__latest")))
    window = Window.partitionBy(*part).orderBy(F.asc_nulls_first("__time"), "__side", "__latest").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("__last", F.last("__latest", ignorenulls=True).over(window)).where("__side = 1")
    found = filled.select("__left.*", *(F.col(f"__last.{v}").alias(f"{v}{suffix}") for v in values))
    missing = left.where(" or ".join(f"`{c}` is null" for c in needed))
    return found.unionByName(missing.select("*", *(F.lit(None).cast(right.schema[v].dataType).alias(f"{v}{suffix}") for v in values)))
