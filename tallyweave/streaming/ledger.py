"""Structured Streaming forms of the serving path: replay dedupe, hourly bursts, scored micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def without_replays(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Exact replays within the watermark are dropped; state is bounded by the delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def hourly(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Payments and amounts by user and clock hour."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("hour"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def score_batches(stream: DataFrame, score: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch is scored as a request against the frozen graph and handed to the sink, which
    gets the batch number so that a retried batch can be written once."""
    return stream.writeStream.foreachBatch(lambda df, k: write(score(df), k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
