"""Bindings shared by the registered queries: event sentiment, class series, SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.functions.labels import map_values, sentiment_sign
from tidegauge.operators.stats import standardise
from tidegauge.operators.timeseries import resample_counts
from tidegauge.sources.tables import table

FREQ = "10 minutes"

# Sentiment name bound to each event type of the test tables.
EVENT_SENTIMENT = {"purchase": "positive", "signup": "positive", "view": "neutral",
                   "click": "neutral", "error": "negative"}


def labelled_events(spark: SparkSession, folder: str) -> DataFrame:
    """events plus ``airline_sentiment`` (name) and ``sentiment`` (sign)."""
    ev = table(spark, folder, "events")
    named = ev.withColumn("airline_sentiment", map_values("event_type", EVENT_SENTIMENT))
    return named.withColumn("sentiment", sentiment_sign("airline_sentiment"))


def class_series(spark: SparkSession, folder: str, freq: str = FREQ) -> DataFrame:
    """Zero-filled counts per sentiment: ``sentiment, ts_bin, cnt``."""
    ev = labelled_events(spark, folder).select("ts", "sentiment")
    return resample_counts(ev, "ts", freq, ["sentiment"])


def z_series(spark: SparkSession, folder: str) -> DataFrame:
    return standardise(class_series(spark, folder), "cnt", ["sentiment"])


def lag_predictions(series: DataFrame, keys=("sentiment",), ts="ts_bin", value="z") -> DataFrame:
    """Persistence prediction: the previous bin. The first bin of a series has none."""
    from tidegauge.operators.timeseries import ordered
    return (series.withColumn("forecast", F.lag(value).over(ordered(list(keys), ts)))
            .where("forecast IS NOT NULL").select(*keys, ts, "forecast"))


def monthly_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals per month and priority: ``priority, ts, y``."""
    o = table(spark, folder, "orders").where(
        "o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL")
    return (o.groupBy(F.col("o_orderpriority").alias("priority"),
                      F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("y")))


SQL_EVENTS = """ev AS (SELECT *,
  CASE WHEN event_type IN ('purchase','signup') THEN 'positive'
       WHEN event_type IN ('view','click') THEN 'neutral'
       WHEN event_type = 'error' THEN 'negative' END AS airline_sentiment,
  CASE WHEN event_type IN ('purchase','signup') THEN 1
       WHEN event_type IN ('view','click') THEN 0
       WHEN event_type = 'error' THEN -1 END AS sentiment FROM events)"""

SQL_SERIES = SQL_EVENTS + """,
bins AS (SELECT sentiment, time_bucket(INTERVAL 10 MINUTE, ts) AS ts_bin, count(*) AS cnt
  FROM ev GROUP BY 1, 2),
spine AS (SELECT sentiment, unnest(generate_series(min(ts_bin), max(ts_bin), INTERVAL 10 MINUTE))
  AS ts_bin FROM bins GROUP BY sentiment),
series AS (SELECT s.sentiment, s.ts_bin, coalesce(b.cnt, 0) AS cnt
  FROM spine s LEFT JOIN bins b ON b.sentiment = s.sentiment AND b.ts_bin = s.ts_bin)"""

SQL_Z = SQL_SERIES + """,
zs AS (SELECT sentiment, ts_bin, cnt, CASE WHEN stddev_pop(cnt) OVER w = 0 THEN 0.0::DOUBLE
    ELSE (cnt - avg(cnt) OVER w) / stddev_pop(cnt) OVER w END AS z
  FROM series WINDOW w AS (PARTITION BY sentiment))"""

SQL_MONTHLY = """monthly AS (SELECT o_orderpriority AS priority,
  date_trunc('month', o_orderdate)::TIMESTAMP AS ts,
  round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2)"""

SQL_PRED_PLAIN = SQL_SERIES + """,
pred AS (SELECT sentiment, ts_bin FROM (SELECT sentiment, ts_bin,
  row_number() OVER (PARTITION BY sentiment ORDER BY ts_bin) AS k FROM series) WHERE k > 1)"""
