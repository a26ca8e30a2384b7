"""Shared helpers: table loading and scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive lost executors.

    ``keep`` writes a frame as Parquet and rereads it. ``drop`` removes tables that no later frame
    reads, which operators do as soon as a table is consumed; what their results still read goes
    when the driver's interpreter ends, or with ``clear``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/polyframe-{label}-{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(self.clear)

    def keep(self, frame: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.base}/{self._count}"
        frame.write.mode("overwrite").parquet(path)
        # The schema is known: no job to infer it, and empty tables reread as they were written.
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self._delete(frame._scratch_path)

    def clear(self) -> None:
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        if self.spark.sparkContext._jsc is None:
            return
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit; a left-over folder does no harm
            pass
