"""STR: each query replays table rows as messages, runs the stream to its end and reads the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.labels import map_values
from tidegauge.operators import stats as S
from tidegauge.operators.model import fit_text_classifier
from tidegauge.plans import anomaly
from tidegauge.queries import query
from tidegauge.queries.common import (
    FREQ, SQL_EVENTS, SQL_SERIES, labelled_events, lag_predictions,
)
from tidegauge.queries.learning import LANG_ID, LANGS
from tidegauge.queries.sources import scratch
from tidegauge.queries.statistics import SQL_FLAGS
from tidegauge.sources.tables import table
from tidegauge.streaming import ingest as I, monitor as N

COLUMNS = [("event_id", "bigint"), ("airline_sentiment", "string"), ("value", "double")]
KEY = ["sentiment"]


def replayed(spark, folder):
    """Folder of messages, one per event."""
    path = scratch(spark, "messages")
    I.replay(labelled_events(spark, folder), "ts", [c for c, _ in COLUMNS], path)
    return path


def event_stream(spark, folder):
    return I.parse(I.read_messages(spark, replayed(spark, folder)), COLUMNS)


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


SQL_SECONDS = SQL_EVENTS + """,
m AS (SELECT date_trunc('second', ts)::TIMESTAMP AS ts, event_id, airline_sentiment, value, sentiment FROM ev)"""


@query("str01_stream_source", f"WITH {SQL_SECONDS} SELECT ts, event_id, sentiment FROM m")
def stream_source(spark, folder):
    out = scratch(spark, "stream")
    rows = event_stream(spark, folder).select("ts", "event_id", "sentiment")
    I.run_available(I.append_to_table(rows, out, scratch(spark, "ckpt")))
    return ntz(spark.read.parquet(out), "ts")


@query("str02_replay", f"""WITH {SQL_EVENTS}
SELECT '["' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '+0000",' || event_id || ',"' || airline_sentiment ||
  '"]' AS body FROM ev""")
def replay(spark, folder):
    path = scratch(spark, "messages")
    I.replay(labelled_events(spark, folder), "ts", ["event_id", "airline_sentiment"], path)
    return spark.read.schema(I.MESSAGE_SCHEMA).parquet(path).select("body")


@query("str03_post_collector", """SELECT conv_id, turn, 'neutral' AS airline_sentiment, 0.6771::DOUBLE AS confidence,
  'American' AS airline, 'johnydoe' AS name, text, 'Washington, DC' AS tweet_location
FROM conversations""")
def post_collector(spark, folder):
    from tidegauge.sources.events import EVENT_COLUMNS, from_message
    posts = table(spark, folder, "conversations").withColumn("sentiment", F.lit("neutral"))
    at = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    path = scratch(spark, "posts")
    I.post_message(posts, "text", "sentiment", at, ["conv_id", "turn"]).write.parquet(path)
    parsed = from_message(spark.read.schema(I.MESSAGE_SCHEMA).parquet(path), "body", EVENT_COLUMNS[1:])
    ids = posts.select("conv_id", "turn", F.abs(F.xxhash64("conv_id", "turn")).alias("tweet_id"))
    return parsed.join(ids, "tweet_id").select(
        "conv_id", "turn", "airline_sentiment",
        F.col("airline_sentiment_confidence").alias("confidence"), "airline", "name", "text",
        "tweet_location")


@query("str04_after_offset", f"""WITH {SQL_SECONDS} SELECT m.event_id, m.ts FROM m
JOIN events e ON e.event_id = m.event_id WHERE e.ts > TIMESTAMP '2024-01-20 00:00:00'""")
def after_offset(spark, folder):
    out = scratch(spark, "stream")
    stream = I.read_messages(spark, replayed(spark, folder))
    rows = I.parse(I.after_offset(stream, "2024-01-20 00:00:00"), COLUMNS).select("event_id", "ts")
    I.run_available(I.append_to_table(rows, out, scratch(spark, "ckpt")))
    return ntz(spark.read.parquet(out), "ts")


@query("str05_append", f"WITH {SQL_SECONDS} SELECT event_id, airline_sentiment, value FROM m")
def append(spark, folder):
    out = scratch(spark, "stream")
    rows = event_stream(spark, folder).select("event_id", "airline_sentiment", "value")
    I.run_available(I.append_to_table(rows, out, scratch(spark, "ckpt")))
    return spark.read.parquet(out)


@query("str06_stream_resample", f"WITH {SQL_SERIES} SELECT sentiment, ts_bin, cnt FROM series")
def stream_resample(spark, folder):
    out = scratch(spark, "counts")
    counts = N.stream_counts(event_stream(spark, folder), "ts", FREQ, KEY)
    I.run_available(N.write_updates(counts, out, scratch(spark, "ckpt")))
    return ntz(N.read_series(spark, out, KEY, FREQ), "ts_bin")


@query("str06_compacted_counts", f"WITH {SQL_SERIES} SELECT sentiment, ts_bin, cnt FROM series")
def compacted_counts(spark, folder):
    """Several batches, then one folder for each closed day; the series stays the same."""
    path, out = scratch(spark, "messages"), scratch(spark, "counts")
    I.replay(labelled_events(spark, folder).repartitionByRange(4, "ts"), "ts", [c for c, _ in COLUMNS], path)
    counts = N.stream_counts(I.parse(I.read_messages(spark, path, 1), COLUMNS), "ts", FREQ, KEY, "60 days")
    I.run_available(N.write_updates(counts, out, scratch(spark, "ckpt")))
    last = spark.read.parquet(out).agg(F.max("day")).first()[0]
    if last is not None:
        N.compact_days(spark, out, KEY, last)
    return ntz(N.read_series(spark, out, KEY, FREQ), "ts_bin")


@query("str07_stream_trailing", f"""WITH {SQL_SERIES},
neg AS (SELECT * FROM series WHERE sentiment = -1), l AS (SELECT max(ts_bin) AS last FROM neg)
SELECT coalesce(sum(cnt) FILTER (ts_bin >= last - INTERVAL 1 MINUTE), 0)::BIGINT AS "1min",
  coalesce(sum(cnt) FILTER (ts_bin >= last - INTERVAL 10 MINUTE), 0)::BIGINT AS "10min",
  coalesce(sum(cnt) FILTER (ts_bin >= last - INTERVAL 60 MINUTE), 0)::BIGINT AS "60min",
  false AS anomaly_found, false AS last_bin_anomaly FROM neg, l""")
def stream_trailing(spark, folder):
    out, summary = scratch(spark, "counts"), scratch(spark, "summary")
    counts = N.stream_counts(event_stream(spark, folder), "ts", FREQ, KEY)
    I.run_available(N.trailing_stats(counts, out, summary, scratch(spark, "ckpt"), KEY,
                                     "sentiment = -1", FREQ))
    rows = spark.read.parquet(summary)
    return rows.where(F.col("batch_id") == rows.agg(F.max("batch_id")).scalar()).drop("batch_id")


@query("str07_stream_trailing_quiet_class", f"""WITH {SQL_SERIES.replace("FROM events)", "FROM events WHERE event_type <> 'error' OR ts < (SELECT min(ts) + INTERVAL 2 DAY FROM events))")},
neg AS (SELECT * FROM series WHERE sentiment = -1), l AS (SELECT max(ts_bin) AS last FROM neg)
SELECT coalesce(sum(cnt) FILTER (ts_bin >= last - INTERVAL 1 MINUTE), 0)::BIGINT AS "1min",
  coalesce(sum(cnt) FILTER (ts_bin >= last - INTERVAL 10 MINUTE), 0)::BIGINT AS "10min",
  coalesce(sum(cnt) FILTER (ts_bin >= last - INTERVAL 60 MINUTE), 0)::BIGINT AS "60min",
  false AS anomaly_found, false AS last_bin_anomaly FROM neg, l""")
def stream_trailing_quiet(spark, folder):
    """The class falls silent after two days; its sums stay those of its last hour."""
    events = labelled_events(spark, folder)
    end = events.agg(F.min("ts") + F.expr("INTERVAL 2 DAYS")).scalar()
    loud = events.where((F.col("event_type") != "error") | (F.col("ts") < end))
    path, out, summary = scratch(spark, "messages"), scratch(spark, "counts"), scratch(spark, "summary")
    I.replay(loud.repartitionByRange(4, "ts"), "ts", [c for c, _ in COLUMNS], path)
    counts = N.stream_counts(I.parse(I.read_messages(spark, path, 2), COLUMNS), "ts", FREQ, KEY, "60 days")
    I.run_available(N.trailing_stats(counts, out, summary, scratch(spark, "ckpt"), KEY, "sentiment = -1", FREQ))
    rows = spark.read.parquet(summary)
    return rows.where(F.col("batch_id") == rows.agg(F.max("batch_id")).scalar()).drop("batch_id")


@query("str08_stream_anomalies", f"""WITH {SQL_FLAGS}
SELECT b.sentiment, b.ts_bin, b.cnt, f.anomaly FROM bins b
LEFT JOIN flags f ON f.sentiment = b.sentiment AND f.ts_bin = b.ts_bin""")
def stream_anomalies(spark, folder):
    z = anomaly.prepare(labelled_events(spark, folder))
    flags = anomaly.flag(z, lag_predictions(z))
    limits = S.fit_standard(z, "cnt", KEY).join(
        flags.select("sentiment", "ts_bin", "threshold"), KEY)
    stored = scratch(spark, "thresholds")
    limits.withColumn("ts_bin", F.col("ts_bin").cast("timestamp")).write.parquet(stored)
    out = scratch(spark, "flags")
    counts = N.stream_counts(event_stream(spark, folder), "ts", FREQ, KEY)
    scored = N.score_bins(counts, spark.read.parquet(stored), KEY)
    I.run_available(N.write_updates(scored, out, scratch(spark, "ckpt")))
    return ntz(N.latest_flags(spark, out, KEY).select("sentiment", "ts_bin", "cnt", "anomaly"),
               "ts_bin")


def scoring_model(spark, folder):
    docs = table(spark, folder, "documents").select(
        "text", map_values("lang", LANG_ID).alias("target"))
    return fit_text_classifier(docs, "text", "target", max_iter=50)


@query("str03_scored_posts", """SELECT count(*) AS posts, 0::BIGINT AS changed FROM conversations""")
def scored_posts(spark, folder):
    """Every post is scored by the model, published with its label and parsed again."""
    from tidegauge.sources.events import EVENT_COLUMNS, from_message
    posts = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    scored = I.score_posts(posts, scoring_model(spark, folder), LANGS)
    path = scratch(spark, "posts")
    at = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    I.post_message(scored, "text", "label", at, ["conv_id", "turn"]).write.parquet(path)
    parsed = from_message(spark.read.schema(I.MESSAGE_SCHEMA).parquet(path), "body", EVENT_COLUMNS[1:])
    ids = scored.select(F.abs(F.xxhash64("conv_id", "turn")).alias("tweet_id"), "label")
    both = ids.join(parsed, "tweet_id", "left")
    return both.agg(F.count(F.lit(1)).alias("posts"), F.count_if(
        ~F.col("label").eqNullSafe(F.col("airline_sentiment"))).alias("changed"))


@query("str09_stream_equals_batch", """SELECT count(*) AS texts, 0::BIGINT AS different FROM conversations""")
def stream_equals_batch(spark, folder):
    """Labels from the stream against those of one batch, under the same model."""
    posts = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    path, out, model = scratch(spark, "posts"), scratch(spark, "scored"), scoring_model(spark, folder)
    posts.write.parquet(path)
    scored = I.score_texts(spark.readStream.schema(posts.schema).parquet(path), model, LANGS)
    I.run_available(I.append_to_table(scored.select("conv_id", "turn", "label"), out, scratch(spark, "ckpt")))
    batch = I.score_posts(posts, model, LANGS).select("conv_id", "turn", F.col("label").alias("want"))
    both = batch.join(spark.read.parquet(out), ["conv_id", "turn"], "full")
    return both.agg(F.count(F.lit(1)).alias("texts"), F.count_if(
        ~F.col("label").eqNullSafe(F.col("want"))).alias("different"))


@query("str09_stream_scoring")
def stream_scoring(spark, folder):
    model = scoring_model(spark, folder)
    path = scratch(spark, "posts")
    posts = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    posts.write.parquet(path)
    out = scratch(spark, "scored")
    stream = spark.readStream.schema(posts.schema).parquet(path)
    scored = I.score_texts(stream, model, LANGS).select("conv_id", "turn", "label")
    I.run_available(I.append_to_table(scored, out, scratch(spark, "ckpt")))
    return spark.read.parquet(out)


@query("str10_notification", f"""WITH {SQL_SECONDS}
SELECT 'data published' AS message, count(*) AS rows, max(ts) AS last_ts FROM m""")
def notification(spark, folder):
    data, notes = scratch(spark, "data"), scratch(spark, "notices")
    I.run_available(I.notify_appends(event_stream(spark, folder), data, notes, "ts",
                                     scratch(spark, "ckpt")))
    sent = spark.read.parquet(notes)
    return ntz(sent.groupBy("message").agg(F.sum("rows").alias("rows"),
                                           F.max("last_ts").alias("last_ts")), "last_ts")
