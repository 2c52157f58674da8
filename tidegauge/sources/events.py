"""The event table: scan, range read, append, re-timing, high-water mark, message form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidegauge.functions.labels import SENTIMENT_SIGN, map_values
from tidegauge.functions.scalars import format_time, to_epoch
from tidegauge.sources.tables import read_csv

# Columns of the event file and the message, in slot order.
EVENT_COLUMNS = [
    ("tweet_created", "timestamp"), ("tweet_id", "bigint"), ("airline_sentiment", "string"),
    ("airline_sentiment_confidence", "double"), ("negativereason", "string"),
    ("negativereason_confidence", "double"), ("airline", "string"),
    ("airline_sentiment_gold", "string"), ("name", "string"), ("negativereason_gold", "string"),
    ("retweet_count", "int"), ("text", "string"), ("tweet_coord", "string"),
    ("tweet_location", "string"), ("user_timezone", "string"),
]
TIME_FORMAT = "yyyy-MM-dd HH:mm:ssxx"


def event_schema() -> T.StructType:
    """Declared schema of the event table."""
    return T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in EVENT_COLUMNS))


def read_events(spark: SparkSession, path: str, begin: str | None = None,
                end: str | None = None) -> DataFrame:
    """Event CSV with declared types, optionally limited to the open interval (begin, end)."""
    schema = event_schema()
    schema["tweet_created"].dataType = T.StringType()
    raw = read_csv(spark, path, schema)
    events = raw.withColumn("tweet_created", F.try_to_timestamp("tweet_created"))
    return offset_range(events, "tweet_created", begin, end)


def offset_range(events: DataFrame, ts: str, begin=None, end=None) -> DataFrame:
    """Rows strictly after ``begin`` and strictly before ``end``; each bound is optional.

    Bounds are text, or a Column such as a scalar subquery. Nothing is ever written back.
    """
    kind = events.schema[ts].dataType
    if begin is not None:
        events = events.where(F.col(ts) > _instant(begin, kind))
    if end is not None:
        events = events.where(F.col(ts) < _instant(end, kind))
    return events


def _instant(value, kind) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast(kind)


def add_data(events: DataFrame, new: DataFrame) -> DataFrame:
    """Events plus new rows, matched by column name."""
    return events.unionByName(new)


def append_data(new: DataFrame, path: str) -> None:
    """Durable form of ``add_data``: only the new rows are written."""
    new.write.mode("append").parquet(path)


def retime(events: DataFrame, ts: str, anchor: str) -> DataFrame:
    """Shift every instant by ``anchor - max(ts)``."""
    last = events.agg(F.max(ts)).scalar()
    kind = events.schema[ts].dataType
    return events.withColumn(ts, F.col(ts) + (F.lit(anchor).cast(kind) - last))


def high_water_mark(events: DataFrame, ts: str) -> DataFrame:
    """One row: newest instant as epoch seconds and as a time."""
    return events.agg(F.max(ts).alias("original_datetime")).select(
        to_epoch("original_datetime").alias("original"), "original_datetime")


def publish_high_water_mark(events: DataFrame, ts: str, path: str) -> None:
    high_water_mark(events, ts).write.mode("overwrite").parquet(path)


def to_message(df: DataFrame, ts: str, columns: list[str]) -> Column:
    """JSON array: formatted time in slot 0, then the columns of ``df`` in order.

    Whole numbers and flags are written as they are; other values go through ``to_json`` of a
    one-element array, whose brackets are cut off, so typing and escaping are JSON's own.
    """
    def item(name: str) -> Column:
        if isinstance(df.schema[name].dataType, (T.IntegralType, T.BooleanType)):
            text = F.col(name).cast("string")
        else:
            wrapped = F.to_json(F.array(F.col(name)))
            text = F.when(F.col(name).isNotNull(), F.substring(wrapped, F.lit(2), F.length(wrapped) - 2))
        return F.coalesce(text, F.lit("null"))

    quote = F.lit('"')
    when = F.coalesce(F.concat(quote, format_time(ts), quote), F.lit("null"))
    return F.concat(F.lit("["), F.concat_ws(",", when, *[item(c) for c in columns]), F.lit("]"))


def from_message(messages: DataFrame, body: str, columns: list[tuple[str, str]],
                 sentiment_from: str | None = None) -> DataFrame:
    """Typed row from a JSON array message.

    Slot 0 is the time, either epoch seconds or formatted text; later slots follow ``columns``.
    ``sentiment_from`` names the column from which the numeric sentiment is derived.
    """
    slots = messages.withColumn("_a", F.from_json(body, "array<string>"))
    zero = F.get("_a", F.lit(0))
    # the pattern test spares every formatted time a failing number parse
    epoch = F.when(zero.rlike(r"^-?\d{1,18}$"), zero).try_cast("bigint")
    when = F.coalesce(F.timestamp_seconds(epoch), F.try_to_timestamp(zero, F.lit(TIME_FORMAT)))
    typed = [F.get("_a", F.lit(i + 1)).try_cast(t).alias(n) for i, (n, t) in enumerate(columns)]
    out = slots.select(*[c for c in messages.columns if c != body], when.alias("ts"), *typed)
    if sentiment_from:
        out = out.withColumn("sentiment", map_values(sentiment_from, SENTIMENT_SIGN))
    return out
