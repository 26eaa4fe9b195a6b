"""Incremental runs over arriving files: new snapshots update a table of schema changes batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scalarscape.operators.drift import read_drifting

FILES = "file_id bigint, series string, file_seq int, written_at timestamp_ntz, received_at timestamp_ntz, body string"


def land_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Route the files that arrive in ``source`` (Parquet) through the migration steps into ``target``; each batch is written once.

    A batch replaces its own folder if it runs again after a failure, so the result is
    exactly once; a file sent again in a later batch is dropped when ``target`` is read by
    ``landed``.
    """

    def write(batch: DataFrame, number: int) -> None:
        read_drifting(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    arriving = spark.readStream.schema(FILES).parquet(source)
    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed(spark: SparkSession, target: str) -> DataFrame:
    """The landed table, each file once, by its first batch."""
    rows = spark.read.option("basePath", target).parquet(f"{target}/batch=*")
    first = rows.groupBy("file_id").agg(F.min("batch").alias("batch"))
    return rows.join(first, ["file_id", "batch"]).drop("batch")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total) of a stream of events by tumbling window, late rows accepted up to ``late``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    got = timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
