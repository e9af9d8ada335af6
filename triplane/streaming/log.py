"""Streams: the transaction log as a file stream, listeners fed by micro-batches, and windows over event time.

Windows are an addition; the query language itself has none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "tx long, e long, a string, v string, added boolean"


def append_log(df: DataFrame, path: str) -> None:
    """More rows of the log (see :func:`triplane.transact.tx_log`)."""
    df.write.mode("append").parquet(path)


def open_log(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Logged facts of transactions from ``start`` up to, not including, ``end``."""
    df = spark.read.schema(SCHEMA).parquet(path).where(F.col("tx") >= start)
    return df if end is None else df.where(F.col("tx") < end)


def tail_log(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """The log as a stream that goes on."""
    return spark.readStream.schema(SCHEMA).parquet(path).where(F.col("tx") >= start)


def listen(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls back with each micro-batch; one that failed comes again."""
    return stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, window: str, *keys: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by window and keys; events later than ``late`` are dropped from a stream."""
    df = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Counts by session: runs of a key's events with gaps less than ``gap``."""
    df = events.withWatermark(time, late) if events.isStreaming else events
    grouped = df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
