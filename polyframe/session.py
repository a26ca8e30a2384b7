"""Session settings for this package."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "polyframe", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the package's settings; ``settings`` come on top, with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Used only by local masters whose session names no shared folder, as in tests on one machine.
LOCAL_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local master gets one of our own; on a cluster there is no folder to
    guess that all executors see, so that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError(f"master {context.master}: set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(LOCAL_SHARED)
        named = context.getCheckpointDir()
    return named.rstrip("/")


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder, removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/polyframe-{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        if spark.sparkContext._jsc is None:
            return  # the application has ended
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    atexit.register(remove)
    return path
