"""Streams give what the batch plan gives, over several micro-batches and restarts."""

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tidegauge.operators import timeseries as W
from tidegauge.queries.common import labelled_events
from tidegauge.streaming import ingest as I, monitor as N

COLUMNS = [("event_id", "bigint"), ("airline_sentiment", "string"), ("value", "double")]
KEY = ["sentiment"]
FREQ = "10 minutes"


def drop_in_time_order(df, path, files):
    """Replay in time order, one file after the other, so that each becomes one micro-batch."""
    placed = df.withColumn("_f", F.ntile(files).over(Window.orderBy("ts")))
    for i in range(1, files + 1):
        I.replay(placed.where(F.col("_f") == i).coalesce(1), "ts", [c for c, _ in COLUMNS], path)


@pytest.fixture()
def folder(spark, sf, tmp_path):
    path = str(tmp_path / "messages")
    drop_in_time_order(labelled_events(spark, sf), path, 5)
    return path


def stream(spark, path):
    return I.parse(I.read_messages(spark, path, 1), COLUMNS)


def batch_series(spark, sf):
    ev = labelled_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return W.resample_counts(ev, "ts", FREQ, KEY)


def same(a, b):
    def key(df):
        return sorted(tuple(str(v) for v in r) for r in df.collect())
    return key(a) == key(b)


def test_resample_equals_batch_over_many_batches(spark, sf, folder, tmp_path):
    out = str(tmp_path / "counts")
    counts = N.stream_counts(stream(spark, folder), "ts", FREQ, KEY)
    I.run_available(N.write_updates(counts, out, str(tmp_path / "ckpt")))
    assert spark.read.parquet(out).select("batch_id").distinct().count() >= 5
    got = N.read_series(spark, out, KEY, FREQ).select("sentiment", "ts_bin", "cnt")
    assert same(got, batch_series(spark, sf).select("sentiment", "ts_bin", "cnt"))


def test_trailing_stats_follow_each_batch(spark, sf, folder, tmp_path):
    out, summary = str(tmp_path / "counts"), str(tmp_path / "summary")
    counts = N.stream_counts(stream(spark, folder), "ts", FREQ, KEY)
    I.run_available(N.trailing_stats(counts, out, summary, str(tmp_path / "ckpt"), KEY,
                                     "sentiment = -1", FREQ))
    rows = spark.read.parquet(summary)
    assert rows.count() >= 5
    last = rows.orderBy(F.desc("batch_id")).first()
    want = W.trailing_sums(batch_series(spark, sf).where("sentiment = -1"), [1, 10, 60]).first()
    assert (last["1min"], last["10min"], last["60min"]) == tuple(want)


def test_restart_continues_from_the_checkpoint(spark, sf, folder, tmp_path):
    out, ckpt = str(tmp_path / "rows"), str(tmp_path / "ckpt")
    I.run_available(I.append_to_table(stream(spark, folder), out, ckpt))
    I.run_available(I.append_to_table(stream(spark, folder), out, ckpt))
    assert spark.read.parquet(out).count() == 1000
    more = labelled_events(spark, sf).where("event_id < 7")
    I.replay(more.coalesce(1), "ts", [c for c, _ in COLUMNS], folder)
    I.run_available(I.append_to_table(stream(spark, folder), out, ckpt))
    assert spark.read.parquet(out).count() == 1007


def test_rows_later_than_the_watermark_are_left_out(spark, tmp_path):
    path, out = str(tmp_path / "m"), str(tmp_path / "counts")

    def drop(*times):
        pdf = pd.DataFrame({"ts": pd.to_datetime(list(times)), "event_id": range(len(times)),
                            "airline_sentiment": "negative", "value": 1.0})
        I.replay(spark.createDataFrame(pdf).coalesce(1), "ts", [c for c, _ in COLUMNS], path)

    ckpt = str(tmp_path / "ckpt")
    for times in (["2024-01-01 00:05:00"], ["2024-01-01 05:00:00"],
                  ["2024-01-01 00:06:00", "2024-01-01 04:30:00", "2024-01-01 05:01:00"]):
        drop(*times)
        counts = N.stream_counts(stream(spark, path), "ts", FREQ, KEY)
        I.run_available(N.write_updates(counts, out, ckpt))
    got = {str(r.ts_bin)[11:16]: r.cnt for r in N.latest_counts(spark, out, KEY).collect()}
    assert got == {"00:00": 1, "05:00": 2, "04:30": 1}


def test_offset(spark, folder, tmp_path):
    messages = I.read_messages(spark, folder)
    for name, offset, want in (("none", None, 0), ("old", "2020-01-01", 1000), ("new", "2030-01-01", 0)):
        out = str(tmp_path / name)
        rows = I.after_offset(messages, offset)
        I.run_available(I.append_to_table(rows, out, str(tmp_path / f"ckpt-{name}")))
        assert spark.read.schema(I.MESSAGE_SCHEMA).parquet(out).count() == want


def test_one_notification_per_batch(spark, folder, tmp_path):
    data, notes = str(tmp_path / "data"), str(tmp_path / "notes")
    I.run_available(I.notify_appends(stream(spark, folder), data, notes, "ts", str(tmp_path / "ckpt")))
    sent = spark.read.parquet(notes)
    assert sent.count() == 5 and sent.agg(F.sum("rows")).first()[0] == 1000
    assert spark.read.parquet(data).count() == 1000


def test_repeated_batch_replaces_itself(spark, tmp_path):
    """A retried micro-batch must not count twice."""
    out = str(tmp_path / "counts")
    batch = spark.createDataFrame([(-1, datetime(2024, 1, 1, 0, 10), 3)],
                                  "sentiment int, ts_bin timestamp, cnt long")
    for _ in range(2):
        dated = batch.withColumn("day", F.to_date("ts_bin")).withColumn("batch_id", F.lit(0))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "day", "batch_id").parquet(out)
    assert N.latest_counts(spark, out, KEY).agg(F.sum("cnt")).first()[0] == 3


def test_scoring_equals_batch(spark, folder, sf, tmp_path):
    bins = W.bin_counts(labelled_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")),
                        "ts", FREQ, KEY)
    limits = bins.select("sentiment", "ts_bin", F.lit(0.5).alias("threshold"), F.lit(1.0).alias("mean"),
                         F.lit(1.0).alias("sd"))
    limits.write.parquet(str(tmp_path / "limits"))
    stored = spark.read.parquet(str(tmp_path / "limits"))
    out = str(tmp_path / "flags")
    scored = N.score_bins(N.stream_counts(stream(spark, folder), "ts", FREQ, KEY), stored, KEY)
    I.run_available(N.write_updates(scored, out, str(tmp_path / "ckpt")))
    got = N.latest_flags(spark, out, KEY).select("sentiment", "ts_bin", "anomaly")
    assert same(got, N.score_bins(bins, stored, KEY).select("sentiment", "ts_bin", "anomaly"))
    assert got.where("anomaly = 1").count() > 0


def test_compacted_days_keep_every_bin(spark, tmp_path):
    out = str(tmp_path / "counts")
    versions = {0: [(1, 0, 1), (1, 10, 1)], 1: [(1, 10, 4), (2, 0, 2)], 2: [(2, 0, 5), (3, 0, 1)], 3: [(1, 0, 9), (3, 0, 2)]}
    for batch, bins in versions.items():
        rows = [(-1, datetime(2024, 1, d, 0, m), n, batch) for d, m, n in bins]
        df = spark.createDataFrame(rows, "sentiment int, ts_bin timestamp, cnt long, batch_id int")
        df.withColumn("day", F.to_date("ts_bin")).write.mode("append").partitionBy("day", "batch_id").parquet(out)
    before = sorted(N.latest_counts(spark, out, KEY).collect())
    assert [r.cnt for r in before] == [9, 4, 5, 2]
    assert N.compact_days(spark, out, KEY, datetime(2024, 1, 3).date()) == 2  # day 1: batch 0, day 2: batch 1
    left = {(r.day.day, r.batch_id) for r in spark.read.parquet(out).select("day", "batch_id").distinct().collect()}
    assert left == {(1, 1), (1, 3), (2, 2), (3, 2), (3, 3)}  # the last batch may be written again
    assert sorted(N.latest_counts(spark, out, KEY).collect()) == before
    assert N.compact_days(spark, out, KEY, datetime(2024, 1, 3).date()) == 0
