"""Streaming sources: result messages and job events from a folder of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import EVENT, RESULT_MESSAGE

NUMBERED_EVENT = T.StructType([*EVENT.fields, T.StructField("seq", T.LongType())])
RESULT_STREAM = T.StructType([*RESULT_MESSAGE.fields, T.StructField("ts", T.TimestampType())])


def read_results_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Result messages with their arrival time, from JSON lines as a queue consumer writes them."""
    reader = spark.readStream.schema(RESULT_STREAM)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def read_events_stream(spark: SparkSession, path: str, files_per_batch: int | None = None, numbered: bool = False) -> DataFrame:
    """Job events (cancel, pause, resume) from JSON lines; `numbered` ones carry their sequence number per job."""
    reader = spark.readStream.schema(NUMBERED_EVENT if numbered else EVENT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def live_events(events: DataFrame, now: int) -> DataFrame:
    """Events whose time to live has not run out; a TTL of 0 never does."""
    return events.filter((F.col("ttl") <= 0) | (F.col("ts") + F.col("ttl") > now))
