"""Event-time windows and stateful budgets over a stream of tool events.

The batch forms and the streams are the same functions: they take a frame with ts, user_id, event_type, and a
stream only adds the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "events.parquet") -> DataFrame:
    """The Parquet files of a folder as a stream, with ts as a timestamp."""
    read = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 day", watermark: str | None = None) -> DataFrame:
    held = events.withColumn("ts", F.col("ts").cast("timestamp"))
    held = held.withWatermark("ts", watermark) if watermark else held
    return held.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str = "2 hours", step: str = "1 hour", watermark: str | None = None) -> DataFrame:
    held = events.withColumn("ts", F.col("ts").cast("timestamp"))
    held = held.withWatermark("ts", watermark) if watermark else held
    return held.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    held = events.withColumn("ts", F.col("ts").cast("timestamp"))
    held = held.withWatermark("ts", watermark) if watermark else held
    return held.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def call_counts(events: DataFrame, most: int = 20) -> DataFrame:
    """user_id, calls, allowed after each batch of a user's events: a running call budget kept as state."""
    out = "user_id long, calls long, allowed boolean"

    def count(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        calls = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((calls,))
        yield pd.DataFrame({"user_id": [key[0]], "calls": [calls], "allowed": [calls <= most]})

    return events.groupBy("user_id").applyInPandasWithState(count, out, "calls long", "update", "NoTimeout")
