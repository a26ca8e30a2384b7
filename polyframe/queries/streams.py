"""Streaming runs over a folder of files."""

import uuid

from pyspark.sql import functions as F

from .. import streaming
from ..session import temporary
from .registry import query


@query("SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(t):
    """A stream over the events, counted a day and type; complete mode closes every window."""
    name = f"stream_{uuid.uuid4().hex[:12]}"
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if not _folder(t) else "*.parquet").parquet(f"{t.folder}/events.parquet" if _folder(t) else t.folder)
    counted = streaming.tumbling(stream, "ts", "1 day", ["event_type"], F.count("*").alias("n"))
    started = counted.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    started.awaitTermination()
    return t.spark.table(name).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def _in_turn(t, *batches):
    """A stream of the events' columns that reads these frames one after the other, a batch each."""
    path = temporary(t.spark, "stream")
    for frame in batches:
        frame.coalesce(1).write.mode("append").parquet(path)  # the input of a small stream; files are read by age
    return streaming.read_folder(t.spark, path, t.events.schema, files_per_trigger=1)


#: Events that come late: the early ones of every tenth number, after all others.
LATE = "event_id % 10 = 0 AND ts < TIMESTAMP '2024-01-10 00:00:00'"


@query(f"""WITH days AS (SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start FROM events WHERE NOT ({LATE}))
           SELECT event_type, start, count(*) AS n FROM days GROUP BY event_type, start
           HAVING start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_late_rows(t):
    """Rows behind the watermark are left out; windows that it has passed go to files."""
    late = LATE.replace("TIMESTAMP", "TIMESTAMP_NTZ")
    # Rows are late by the watermark that the batch before theirs began with, hence three batches.
    early, rest = (f"ts {sign} TIMESTAMP_NTZ '2024-01-20 00:00:00' AND NOT ({late})" for sign in ("<", ">="))
    counted = streaming.tumbling(_in_turn(t, *map(t.events.where, (early, rest, late))), "ts", "1 day", ["event_type"], F.count("*").alias("n"), late="1 day")
    path, checkpoint = temporary(t.spark, "windows"), temporary(t.spark, "progress")
    streaming.run_once(counted, path, checkpoint)
    return t.spark.read.parquet(path).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH marked AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM marked)
          SELECT user_id, min(ts) AS start, count(*) AS n FROM numbered GROUP BY user_id, k HAVING max(ts) + INTERVAL 4 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(t):
    """Session windows of a stream, closed by its watermark, in files."""
    half = F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    opened = streaming.sessions(_in_turn(t, t.events.where(half), t.events.where(~half)), "ts", "4 hours", ["user_id"], F.count("*").alias("n"), late="1 hour")
    path, checkpoint = temporary(t.spark, "sessions"), temporary(t.spark, "progress")
    streaming.run_once(opened, path, checkpoint)
    return t.spark.read.parquet(path).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def _folder(t) -> bool:
    """Whether the table is a folder of files rather than one file."""
    jvm = t.spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{t.folder}/events.parquet")
    return path.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
