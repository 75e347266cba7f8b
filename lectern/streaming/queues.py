"""Streams over event files: exactly once by key, and windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str, schema, name: str = "*.parquet") -> DataFrame:
    """A stream of the event files of a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def once(stream: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first event of each key; keys are forgotten behind the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by window of event time."""
    return (stream.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
            .select(F.col("window.start").alias("start"), "event_type", "n", "total"))
