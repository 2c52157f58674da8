"""Regular series: zero-filled resampling, rolling, lagged and cumulative windows.

Windows here run over *binned* series and are partitioned by the series key. A series holds one row
per bin, so its length is bounded by the time span, not by the number of events: a hot key is
already aggregated away when a window sees it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from tidegauge.functions.hashing import unit_hash


def ordered(keys: list[str], ts: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ts)


def bin_counts(df: DataFrame, ts: str, freq: str, keys: list[str]) -> DataFrame:
    """Events per tumbling bin, labelled by bin start. Partial counts combine before the shuffle.

    Events without a time or class belong to no series. Dropping them here also gives every use of
    a series the same plan, so that Spark scans the events once and reuses the exchange.
    """
    for column in (ts, *keys):
        df = df.where(F.col(column).isNotNull())
    return (df.groupBy(*keys, F.window(ts, freq).alias("_w"))
            .agg(F.count(F.lit(1)).alias("cnt"))
            .select(*keys, F.col("_w.start").alias("ts_bin"), "cnt"))


def fill_gaps(bins: DataFrame, keys: list[str], freq: str, value: str = "cnt") -> DataFrame:
    """Insert the missing bins of each key's own first..last span with 0.

    Each bin emits itself plus the gap up to its successor, so no spine table is joined.
    """
    following = F.lead("ts_bin").over(ordered(keys, "ts_bin"))
    step = F.expr(f"INTERVAL {freq}")
    slots = bins.withColumn("_last", F.coalesce(following - step, F.col("ts_bin")))
    return (
        slots.select(*keys, value, F.posexplode(F.sequence("ts_bin", "_last", step))
                     .alias("_slot", "ts_bin"))
        .select(*keys, "ts_bin",
                F.when(F.col("_slot") == 0, F.col(value)).otherwise(F.lit(0)).alias(value))
    )


def resample_counts(df: DataFrame, ts: str, freq: str, keys: list[str],
                    common_span: bool = False) -> DataFrame:
    """Zero-filled counts ``(keys..., ts_bin, cnt)``.

    Every key spans its own first to last bin; ``common_span`` stretches all keys to the first and
    last bin of the whole table.
    """
    bins = bin_counts(df, ts, freq, keys)
    if not common_span:
        return fill_gaps(bins, keys, freq)
    step = F.expr(f"INTERVAL {freq}")
    span = bins.agg(F.struct(F.min("ts_bin").alias("lo"), F.max("ts_bin").alias("hi"))).scalar()
    spine = (bins.select(*keys).distinct().withColumn("_span", span)
             .select(*keys, F.explode(F.sequence("_span.lo", "_span.hi", step)).alias("ts_bin")))
    return (spine.join(bins, keys + ["ts_bin"], "left")
            .select(*keys, "ts_bin", F.coalesce("cnt", F.lit(0)).alias("cnt")))


def guarded(agg: Column, value: str, window: WindowSpec, size: int) -> Column:
    """``agg`` over ``window``, null until the frame holds ``size`` values."""
    return F.when(F.count(value).over(window) == size, agg.over(window))


def rolling_median(df: DataFrame, value: str, size: int, keys: list[str], ts: str,
                   out: str) -> DataFrame:
    """Trailing median of ``size`` rows; the incomplete first frames give 0."""
    frame = ordered(keys, ts).rowsBetween(-(size - 1), 0)
    full = guarded(F.percentile(value, F.lit(0.5)), value, frame, size)
    return df.withColumn(out, F.coalesce(full, F.lit(0.0)))


def rolling_mean_std(df: DataFrame, value: str, size: int, keys: list[str], ts: str) -> DataFrame:
    """Trailing mean and sample deviation, null until ``size`` rows are there."""
    frame = ordered(keys, ts).rowsBetween(-(size - 1), 0)
    return (df.withColumn("roll_mean", guarded(F.avg(value), value, frame, size))
            .withColumn("roll_std", guarded(F.stddev_samp(value), value, frame, size)))


def difference(df: DataFrame, value: str, keys: list[str], ts: str, lag: int = 1,
               out: str = "diff") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value, lag).over(ordered(keys, ts)))


def log_difference(df: DataFrame, value: str, keys: list[str], ts: str) -> DataFrame:
    """``log_y`` and its first difference ``log_diff``."""
    logged = df.withColumn("log_y", F.ln(value))
    return difference(logged, "log_y", keys, ts, out="log_diff")


def inverse_log_difference(df: DataFrame, log_value: str, log_diff: str, keys: list[str],
                           ts: str, out: str = "restored") -> DataFrame:
    """exp(first log value + cumulated differences)."""
    whole = ordered(keys, ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = ordered(keys, ts).rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(log_value).over(whole)
    return df.withColumn(out, F.exp(
        first + F.coalesce(F.sum(log_diff).over(upto), F.lit(0.0))))


def cumulative(df: DataFrame, value: str, keys: list[str], ts: str) -> DataFrame:
    """Running sum, product, maximum and minimum."""
    upto = ordered(keys, ts).rowsBetween(Window.unboundedPreceding, 0)
    return (df.withColumn("cumsum", F.sum(value).over(upto))
            .withColumn("cumprod", F.product(value).over(upto))
            .withColumn("cummax", F.max(value).over(upto))
            .withColumn("cummin", F.min(value).over(upto)))


def series_position(df: DataFrame, keys: list[str], ts: str, name: str = "pos") -> DataFrame:
    """Zero-based position inside each binned series."""
    return df.withColumn(name, F.row_number().over(ordered(keys, ts)) - 1)


def next_rolling_window(series: DataFrame, n: int, keys: list[str], ts: str, value: str,
                        freq: str) -> DataFrame:
    """Rotate values left by ``n mod len`` and move the time index ``n`` steps forward.

    The rotated position is computed and the values are re-attached by an equi-join on it.
    """
    whole = Window.partitionBy(*keys)
    placed = (series_position(series.select(*keys, ts, value), keys, ts, "_pos")
              .withColumn("_len", F.count(F.lit(1)).over(whole)))
    index = placed.select(*keys, (F.col(ts) + n * F.expr(f"INTERVAL {freq}")).alias(ts), "_pos")
    values = placed.select(
        *keys, value, F.pmod(F.col("_pos") - n, F.col("_len")).alias("_pos"))
    return index.join(values, keys + ["_pos"]).select(*keys, ts, value)


def lag_frames(df: DataFrame, value: str | list[str], length: int, keys: list[str], ts: str, stride: int = 1,
               sampling_rate: int = 1, start_index: int = 0, end_index: int | None = None,
               reverse: bool = False, shuffle_seed: int | None = None) -> DataFrame:
    """One row per training sample: ``frame`` holds past values, ``target`` the next one.

    Sample targets sit at positions ``start_index + length``, then every ``stride`` rows up to
    ``end_index`` inclusive. ``sampling_rate`` thins the frame, ``reverse`` flips it. With a list of
    columns every slot of the frame, and the target, is the array of their values. ``shuffle_seed``
    adds ``sample_order``, a number from the hash of the sample's key and position: ascending, it
    puts the samples in a random order that no file layout changes. A frame with a hole is left out.
    """
    past = ordered(keys, ts).rowsBetween(-length, -1)
    if isinstance(value, str):
        item = F.col(value).cast("double")
    else:
        row = F.array(*(F.col(c).cast("double") for c in value))
        item = F.when(F.forall(row, lambda v: v.isNotNull()), row)
    framed = series_position(df, keys, ts, "pos").withColumn("frame", F.collect_list(item).over(past))
    keep = ((F.col("pos") >= start_index + length) & (F.size("frame") == length)
            & ((F.col("pos") - start_index - length) % stride == 0))
    if end_index is not None:
        keep = keep & (F.col("pos") <= end_index)
    frame = F.col("frame")
    if sampling_rate > 1:
        frame = F.filter(frame, lambda _, i: i % sampling_rate == 0)
    if reverse:
        frame = F.reverse(frame)
    order = [] if shuffle_seed is None else [unit_hash(*keys, "pos", seed=shuffle_seed).alias("sample_order")]
    return framed.where(keep).select(*keys, ts, "pos", frame.alias("frame"), item.alias("target"), *order)


def trailing_sums(bins: DataFrame, minutes: list[int], ts: str = "ts_bin",
                  value: str = "cnt") -> DataFrame:
    """One row: for each horizon the sum of the bins at or after ``last bin - horizon``.

    The lower end is inclusive, so on ten-minute bins "10min" covers the last two bins.
    """
    last = bins.agg(F.max(ts)).scalar()
    sums = [F.coalesce(F.sum(F.when(
        F.col(ts) >= F.col("_last") - F.expr(f"INTERVAL {m} minutes"), F.col(value))), F.lit(0))
        .alias(f"{m}min") for m in minutes]
    reach = F.expr(f"INTERVAL {max(minutes)} minutes")
    return bins.where(F.col(ts) >= last - reach).withColumn("_last", last).agg(*sums)


def trailing_event_counts(events: DataFrame, ts: str, minutes: list[int]) -> DataFrame:
    """Exact event-level variant: events in ``(last event - horizon, last event]``."""
    last = events.agg(F.max(ts)).scalar()
    recent = events.where(F.col(ts) > last - F.expr(f"INTERVAL {max(minutes)} minutes"))
    return recent.withColumn("_last", last).agg(*[
        F.count_if(F.col(ts) > F.col("_last") - F.expr(f"INTERVAL {m} minutes")).alias(f"{m}min")
        for m in minutes])


def summary_row(bins: DataFrame, anomalies: DataFrame | None = None, ts: str = "ts_bin",
                value: str = "cnt") -> DataFrame:
    """Trailing sums for 1, 10 and 60 minutes plus flags, ready to append to the summary table.

    ``anomaly_found`` stays false as in the established table layout; ``last_bin_anomaly`` carries
    the flag of the newest scored bin.
    """
    row = trailing_sums(bins, [1, 10, 60], ts, value).withColumn("anomaly_found", F.lit(False))
    if anomalies is None:
        return row.withColumn("last_bin_anomaly", F.lit(False))
    flag = anomalies.agg(F.max_by("anomaly", ts)).scalar()
    return row.withColumn("last_bin_anomaly", F.coalesce(flag == 1, F.lit(False)))


def date_range(bounds: DataFrame, start: str, stop: str, step: str, out: str = "ts") -> DataFrame:
    """Regular instants from ``start`` to ``stop`` inclusive for each row of ``bounds``."""
    return bounds.select(F.explode(F.sequence(start, stop, F.expr(f"INTERVAL {step}"))).alias(out))


def chunk_sequences(items: DataFrame, keys: list[str], pos: str, item: str,
                    size: int) -> DataFrame:
    """Cut each keyed sequence into full chunks of ``size`` items; the remainder is dropped.

    The chunk number is part of the grouping key, so no group exceeds ``size`` items.
    """
    chunked = items.groupBy(*keys, F.floor(F.col(pos) / size).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct(pos, item))).alias("_c"))
    return (chunked.where(F.size("_c") == size)
            .select(*keys, "chunk", F.transform("_c", lambda s: s[item]).alias("items")))


def input_target(chunks: DataFrame, items: str = "items") -> DataFrame:
    """``input`` is the chunk without its last item, ``target`` the chunk without its first."""
    n = F.size(items)
    return (chunks.withColumn("input", F.slice(items, F.lit(1), n - 1))
            .withColumn("target", F.slice(items, F.lit(2), n - 1)).drop(items))


def refit_plan(sizes: DataFrame, window: int, total: int, num_lags: int,
               size_col: str = "n") -> DataFrame:
    """Start (inclusive) and end (exclusive) position of every sliding refit window.

    ``ceil(total / num_lags)`` windows per series; the first ends at ``size_col``.
    """
    lags = max(num_lags, 1)
    count = -(-total // lags)
    return (sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("window_id"))
            .withColumn("end_pos", (F.col(size_col) + F.col("window_id") * lags).cast("long"))
            .withColumn("start_pos", F.col("end_pos") - window))
