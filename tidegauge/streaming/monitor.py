"""Continuous counts, trailing sums and anomaly flags."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidegauge.operators.timeseries import fill_gaps, summary_row
from tidegauge.session import spool
from tidegauge.streaming.ingest import per_batch

#: Late rows beyond this are left to a batch rerun.
WATERMARK = "1 hour"


def stream_counts(stream: DataFrame, ts: str, freq: str, keys: list[str],
                  watermark: str = WATERMARK) -> DataFrame:
    """Counts per key and bin; state is kept only until the watermark passes the bin."""
    return (stream.withWatermark(ts, watermark).groupBy(*keys, F.window(ts, freq).alias("_w"))
            .agg(F.count(F.lit(1)).alias("cnt"))
            .select(*keys, F.col("_w.start").alias("ts_bin"), "cnt"))


def write_updates(counts: DataFrame, path: str, checkpoint: str,
                  after=None) -> DataStreamWriter:
    """Changed bins of every micro-batch, under ``day=.../batch_id=...``.

    A repeated batch replaces only its own folders. ``after(spark, batch_id, rows)`` runs once the
    batch is durable; ``rows`` reads back what it wrote.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumn("day", F.to_date("ts_bin")).withColumn("batch_id", F.lit(batch_id))
        # rebalance: few files for small days, several tasks for a large one
        dated.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "day", "batch_id").parquet(path)
        if after is not None:
            # what was written, not the batch again: that would run its aggregation twice
            spark = batch.sparkSession
            stored = spark.read.schema(dated.schema).parquet(path).where(F.col("batch_id") == batch_id)
            after(spark, batch_id, stored)

    return (counts.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint))


def latest_counts(spark, path: str, keys: list[str], since: date | None = None) -> DataFrame:
    """Newest count of every bin written by ``write_updates``, from day ``since`` on."""
    stored = spark.read.parquet(path)
    if since is not None:
        stored = stored.where(F.col("day") >= F.lit(since))
    return stored.groupBy(*keys, "ts_bin").agg(
        F.max_by("cnt", "batch_id").alias("cnt"))


def read_series(spark, path: str, keys: list[str], freq: str) -> DataFrame:
    """Zero-filled series at read time: a stream has no row for an empty bin."""
    return fill_gaps(latest_counts(spark, path, keys), keys, freq)


def trailing_stats(counts: DataFrame, counts_path: str, summary_path: str, checkpoint: str,
                   keys: list[str], only: str, freq: str) -> DataStreamWriter:
    """Update counts, then write the 1, 10 and 60 minute sums of the rows matching ``only``.

    The sums end at the newest bin of those rows, which may be long ago. Every batch writes the last
    bin of each key, as of that batch, so that only the day folders which can hold the hour before
    it are read, however long the history and however quiet the rows.
    """
    lasts_path = summary_path.rstrip("/") + "-last"

    def summarise(spark, batch_id: int, rows: DataFrame) -> None:
        seen = rows.select(*keys, "ts_bin")
        if batch_id > 0:
            seen = seen.unionByName(spark.read.schema(seen.schema).parquet(per_batch(lasts_path, batch_id - 1)))
        lasts = seen.groupBy(*keys).agg(F.max("ts_bin").alias("ts_bin"))
        lasts.write.mode("overwrite").parquet(per_batch(lasts_path, batch_id))
        stored = spark.read.schema(lasts.schema).parquet(per_batch(lasts_path, batch_id))
        newest = stored.where(only).agg(F.max("ts_bin")).first()[0]
        if newest is None:
            return
        since = (newest - timedelta(days=1)).date()
        recent = latest_counts(spark, counts_path, keys, since).where(only)
        row = summary_row(fill_gaps(recent, keys, freq))
        row.coalesce(1).write.mode("overwrite").parquet(per_batch(summary_path, batch_id))

    return write_updates(counts, counts_path, checkpoint, summarise)


def score_bins(counts: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """Flag streamed bins against stored ``keys, ts_bin, threshold, mean, sd``.

    The stored table is the static side of a stream-static join; a bin without a threshold has a
    null flag, which tells it from one that was scored and found normal.
    """
    joined = counts.join(limits, keys + ["ts_bin"], "left")
    z = (F.col("cnt") - F.col("mean")) / F.col("sd")
    return joined.withColumn("actualvalues", z).withColumn(
        "anomaly", (z > F.col("threshold")).cast("int"))


def latest_flags(spark, path: str, keys: list[str]) -> DataFrame:
    """Newest flag of every bin; versions of a bin are combined before they move."""
    stored = spark.read.parquet(path)
    rest = [c for c in stored.columns if c not in (*keys, "ts_bin")]
    newest = stored.groupBy(*keys, "ts_bin").agg(F.max_by(F.struct(*rest), "batch_id").alias("_r"))
    return newest.select(*keys, "ts_bin", "_r.*")


def compact_days(spark, path: str, keys: list[str], before: date) -> int:
    """Bring every day before ``before`` into the folder of one batch; number of folders dropped.

    For days that the watermark has closed. The newest version of every bin is added to the folder
    of the day's last batch, then the older folders go: readers take the newest version and so see
    the same bins at every moment, and a run that was broken off is finished by the next. The last
    batch of all is left alone, since a restarted stream may write it again.
    """
    stored = spark.read.parquet(path)
    closed = stored.where((F.col("day") < F.lit(before)) & (F.col("batch_id") < stored.agg(F.max("batch_id")).scalar()))
    folders = spool(closed.select("day", "batch_id").distinct())
    many = folders.groupBy("day").agg(F.max("batch_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rest = [c for c in stored.columns if c not in (*keys, "ts_bin", "day", "batch_id")]
    newest = closed.join(many, "day").groupBy(*keys, "ts_bin", "day", F.col("_last").alias("batch_id")).agg(
        F.max_by(F.struct(*rest), closed["batch_id"]).alias("_r"))
    # names of folders, a bounded list: each run leaves one per closed day
    old = folders.join(many, "day").where("batch_id < _last").select("day", "batch_id").collect()
    if not old:
        return 0
    rows = newest.select(*keys, "ts_bin", "_r.*", "day", "batch_id")
    spool(rows).hint("rebalance", "day").write.mode("append").partitionBy("day", "batch_id").parquet(path)
    for day, batch_id in old:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}/batch_id={batch_id}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(old)
