"""Sessions over a stream of events: the streaming form of the query gap_sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(user_id, first, last, n) of sessions that end after a gap; events may be late by `late`.

    A session window is half open: an event exactly one gap after the last starts a new session.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    by = timed.groupBy("user_id", F.session_window("at", gap).alias("w"))
    return by.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("w")


def run_sessions(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Read Parquet files as they arrive, all there are now, and append the sessions that are complete."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return sessions(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def trace_sink(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append traces (ts, ...) as JSON, a folder a day."""
    daily = stream.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return daily.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start()
