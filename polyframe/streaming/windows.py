"""Windowed aggregates over event streams, with watermarks that bound their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_folder(spark: SparkSession, path: str, schema: str | StructType, format: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    # Watermarks need a timestamp with time zone.
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(stream: DataFrame, time: str, width: str, keys: list[str], *aggregates: Column, late: str = "10 minutes") -> DataFrame:
    return _timed(stream, time, late).groupBy(F.window(time, width), *keys).agg(*aggregates)


def sliding(stream: DataFrame, time: str, width: str, slide: str, keys: list[str], *aggregates: Column, late: str = "10 minutes") -> DataFrame:
    return _timed(stream, time, late).groupBy(F.window(time, width, slide), *keys).agg(*aggregates)


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str], *aggregates: Column, late: str = "10 minutes") -> DataFrame:
    return _timed(stream, time, late).groupBy(F.session_window(time, gap), *keys).agg(*aggregates)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", format: str = "parquet") -> None:
    """Processes what is there, then stops; progress is kept in the checkpoint folder."""
    stream.writeStream.format(format).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
