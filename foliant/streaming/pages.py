"""The same operators on streams of files: predictions and events as they arrive, pictures a batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def prediction_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Prediction lines of files that appear in a folder; blank lines are skipped, one that is no record is an error. The
    schema is DDL. That a file is listed once cannot be checked without keeping all names: drop_repeats() does so within
    a time."""
    lines = spark.readStream.format("text").load(folder).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def drop_repeats(rows: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Of rows with one key within `late` of each other the first; state is kept for that long only."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """events with the column as a time with a zone, which watermarks need. Of times without one the session's zone is taken."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def profile(events: DataFrame, width: str, late: str | None = None, slide: str | None = None, time: str = "ts", op: str = "event_type", value: str = "value") -> DataFrame:
    """(start, op, calls, total, peak) of events by windows of time. late: how long a stream waits for events before it closes
    a window; without it, all windows stay open."""
    own = events.withWatermark(time, late) if late else events
    window: Column = F.window(time, width, slide) if slide else F.window(time, width)
    out = own.groupBy(window.alias("w"), F.col(op).alias("op")).agg(F.count("*").alias("calls"), F.sum(value).alias("total"), F.max(value).alias("peak"))
    return out.select(F.col("w.start").alias("start"), "op", "calls", "total", "peak")


def sessions(events: DataFrame, gap: str, late: str | None = None, time: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, start, end, calls) of runs of events of a key with less than `gap` between them."""
    own = events.withWatermark(time, late) if late else events
    out = own.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("calls"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def picture_batches(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], files: int = 100) -> StreamingQuery:
    """Calls handle(pictures, batch id) for the files that appear in a folder, `files` of them at a time: rows (path, content).
    After a failure a batch is handed over again with its id, so what handle writes should be named by it."""
    shape = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.schema(shape).format("binaryFile").option("maxFilesPerTrigger", files).load(folder).select("path", "content")
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle).start()
