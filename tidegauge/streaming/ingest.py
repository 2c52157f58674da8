"""Messages in, events out: replay, stream source, high-water filter, append, notification."""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidegauge.operators.model import predict
from tidegauge.sources.events import from_message, to_message

# Fixed value: messages (here files) taken per micro-batch.
PREFETCH = 1000
MESSAGE_SCHEMA = "header_ts timestamp, body string"

# Constant slots of a collected post.
POST_CONFIDENCE = 0.6771
POST_AIRLINE = "American"
POST_NAME = "johnydoe"
POST_LOCATION = "Washington, DC"


def messages(df: DataFrame, ts: str, columns: list[str]) -> DataFrame:
    """One message per row: event time as header, JSON array as body."""
    return df.select(F.col(ts).cast("timestamp").alias("header_ts"),
                     to_message(df, ts, columns).alias("body"))


def replay(df: DataFrame, ts: str, columns: list[str], path: str) -> None:
    """Append every row of a table to the message folder; partitions write independently."""
    messages(df, ts, columns).write.mode("append").parquet(path)


def post_message(posts: DataFrame, text: str, sentiment: str, posted_at: Column,
                 ids: list[str]) -> DataFrame:
    """Message of a scored post, with an id that a retry reproduces (hash of its keys)."""
    null = F.lit(None).cast("string")
    row = posts.select(
        posted_at.cast("timestamp").alias("_at"),
        F.abs(F.xxhash64(*ids)).alias("tweet_id"), F.col(sentiment).alias("airline_sentiment"),
        F.lit(POST_CONFIDENCE).alias("airline_sentiment_confidence"), null.alias("negativereason"),
        F.lit(0.0).alias("negativereason_confidence"), F.lit(POST_AIRLINE).alias("airline"),
        null.alias("airline_sentiment_gold"), F.lit(POST_NAME).alias("name"),
        null.alias("negativereason_gold"), F.lit(0).alias("retweet_count"),
        F.col(text).alias("text"), null.alias("tweet_coord"),
        F.lit(POST_LOCATION).alias("tweet_location"), null.alias("user_timezone"))
    return messages(row, "_at", [c for c in row.columns if c != "_at"])


def read_messages(spark: SparkSession, path: str, per_trigger: int = PREFETCH) -> DataFrame:
    """Unbounded message table over a folder."""
    return (spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", per_trigger)
            .parquet(path))


def after_offset(stream: DataFrame, offset: Column | str | None) -> DataFrame:
    """Messages whose header time is strictly after the stored offset.

    Without an offset the publisher is not ready, and nothing is accepted.
    """
    if offset is None:
        return stream.where(F.lit(False))
    limit = offset if isinstance(offset, Column) else F.lit(offset).cast("timestamp")
    return stream.where(F.col("header_ts") > limit)


def parse(stream: DataFrame, columns: list[tuple[str, str]],
          sentiment_from: str | None = "airline_sentiment") -> DataFrame:
    return from_message(stream, "body", columns, sentiment_from)


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """File sink in append mode: exactly once across restarts, nothing is rewritten."""
    return (stream.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint))


def per_batch(folder: str, batch_id: int) -> str:
    """Folder of one micro-batch; a repeated batch overwrites only itself."""
    return os.path.join(folder, f"batch_id={batch_id}")


def notify_appends(stream: DataFrame, data_path: str, notice_path: str, ts: str,
                   checkpoint: str) -> DataStreamWriter:
    """Append each micro-batch and write one notification row about it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(per_batch(data_path, batch_id))
        spark = batch.sparkSession
        done = spark.read.schema(batch.schema).parquet(per_batch(data_path, batch_id))
        note = done.agg(F.lit("data published").alias("message"), F.count(F.lit(1)).alias("rows"),
                        F.max(ts).alias("last_ts"))
        note.coalesce(1).write.mode("overwrite").parquet(per_batch(notice_path, batch_id))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def score_texts(stream: DataFrame, model: PipelineModel, labels: list[str]) -> DataFrame:
    """Label for each text of a stream."""
    return predict(model, stream, labels)


def score_posts(posts: DataFrame, model: PipelineModel, labels: list[str]) -> DataFrame:
    """Posts with the label under which they are published."""
    return predict(model, posts, labels).select(*posts.columns, "label")


def run_available(writer: DataStreamWriter) -> None:
    """Process everything there is, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()
