"""Scaling, correlograms, decomposition, error metrics and anomaly flags for binned series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.operators.timeseries import ordered, rolling_median, series_position

# 95th percentile of the standard normal, and median absolute error per unit sigma.
Z_SCORE = 1.6448536269514722
MAE_SCALE = 0.67449
FACTOR = Z_SCORE / MAE_SCALE
# Hours covered by each reporting window.
REPORT_HOURS = {"hour": 1, "day": 24, "week": 168}


# ---- scaling -------------------------------------------------------------------------------

def fit_standard(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean and population deviation per key, to be stored and reused at inference."""
    sd = F.stddev_pop(value)
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"),
                                 F.when(sd == 0, 1.0).otherwise(sd).alias("sd"))


def fit_min_max(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    span = F.max(value) - F.min(value)
    return df.groupBy(*keys).agg(F.min(value).cast("double").alias("mean"),
                                 F.when(span == 0, 1.0).otherwise(span).alias("sd"))


def scale(df: DataFrame, params: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """(value - centre) / width with parameters fitted elsewhere."""
    return _with_params(df, params, keys, out, (F.col(value) - F.col("mean")) / F.col("sd"))


def unscale(df: DataFrame, params: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    return _with_params(df, params, keys, out, F.col(value) * F.col("sd") + F.col("mean"))


def _with_params(df, params, keys, out, expr):
    if keys:
        joined = df.join(params.select(*keys, "mean", "sd"), keys, "left")
        return joined.withColumn(out, expr).drop("mean", "sd")
    one = params.agg(F.first(F.struct("mean", "sd"))).scalar()
    return (df.withColumn("_p", one).withColumns({"mean": F.col("_p.mean"), "sd": F.col("_p.sd")})
            .withColumn(out, expr).drop("mean", "sd", "_p"))


def standardise(series: DataFrame, value: str, keys: list[str], out: str = "z") -> DataFrame:
    """Fit and transform in one go on a binned series; a constant series gives 0."""
    whole = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(whole)
    centred = F.col(value) - F.avg(value).over(whole)
    return series.withColumn(out, F.when(sd == 0, 0.0).otherwise(centred / F.nullif(sd, F.lit(0.0))))


# ---- correlograms and decomposition --------------------------------------------------------

def acf(series: DataFrame, value: str, keys: list[str], ts: str, nlags: int = 20) -> DataFrame:
    """Autocorrelation ``(keys..., lag, acf)`` for lags 0..nlags with the whole-series mean."""
    centred = series.select(*keys, ts, (F.col(value) - F.avg(value).over(
        Window.partitionBy(*keys))).alias("_c"))
    w = ordered(keys, ts)
    shifted = centred.select(*keys, "_c", *[F.lag("_c", k).over(w).alias(f"_l{k}")
                                            for k in range(1, nlags + 1)])
    total = F.sum(F.col("_c") * F.col("_c"))
    ratios = [F.lit(1.0)] + [F.sum(F.col("_c") * F.col(f"_l{k}")) / F.nullif(total, F.lit(0.0))
                             for k in range(1, nlags + 1)]
    wide = shifted.groupBy(*keys).agg(F.array(*ratios).alias("_r"))
    return wide.select(*keys, F.posexplode("_r").alias("lag", "acf"))


def pacf(series: DataFrame, value: str, keys: list[str], ts: str, nlags: int = 20) -> DataFrame:
    """Partial autocorrelation by the Durbin-Levinson recursion on the ``nlags`` ACF values."""
    r = acf(series, value, keys, ts, nlags).where("lag > 0").groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("lag", "acf"))),
                    lambda s: s["acf"]).alias("_r"))
    start = F.struct(F.expr("cast(array() as array<double>)").alias("phi"),
                     F.array(F.lit(1.0)).alias("out"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        seen = F.slice("_r", F.lit(1), k - 1)
        a = ((F.element_at("_r", k) - dot(phi, F.reverse(seen)))
             / F.nullif(F.lit(1.0) - dot(phi, seen), F.lit(0.0)))
        longer = F.concat(F.zip_with(phi, F.reverse(phi), lambda x, y: x - a * y), F.array(a))
        return F.struct(longer.alias("phi"), F.concat(state["out"], F.array(a)).alias("out"))

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(nlags)), start, step, lambda s: s["out"])
    return r.select(*keys, F.posexplode(folded).alias("lag", "pacf"))


def decompose(series: DataFrame, value: str, period: int, keys: list[str], ts: str) -> DataFrame:
    """Additive decomposition into ``trend``, ``seasonal`` and ``resid``.

    The trend is a centred moving average, with half weights at both ends for an even period;
    the seasonal part is the phase mean of the detrended values, centred to mean 0.
    """
    half = period // 2
    w = ordered(keys, ts)
    frame = w.rowsBetween(-half, half)
    body = F.sum(value).over(frame)
    if period % 2 == 0:
        body = body - (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2.0
    full = F.count(value).over(frame) == 2 * half + 1
    base = (series_position(series, keys, ts, "_pos")
            .withColumn("trend", F.when(full, body / float(period)))
            .withColumn("_phase", F.col("_pos") % period))
    phases = base.groupBy(*keys, "_phase").agg(
        F.avg(F.col(value) - F.col("trend")).alias("_mean"))
    centre = F.avg("_mean").over(Window.partitionBy(*keys))
    seasonal = phases.select(*keys, "_phase", (F.col("_mean") - centre).alias("seasonal"))
    return (base.join(seasonal, keys + ["_phase"], "left")
            .withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal"))
            .drop("_pos", "_phase"))


# ---- error metrics -------------------------------------------------------------------------

def regression_metrics(df: DataFrame, actual: str, predicted: str,
                       keys: list[str] = ()) -> DataFrame:
    """mae, mse, rmse and explained variance in one aggregation."""
    err = F.col(actual) - F.col(predicted)
    mse = F.avg(err * err)
    return df.groupBy(*keys).agg(
        F.avg(F.abs(err)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
        (1.0 - F.var_pop(err) / F.nullif(F.var_pop(F.when(err.isNotNull(), F.col(actual))),
                                         F.lit(0.0))).alias("explained_variance"))


def median_absolute_error(left: DataFrame, right: DataFrame, left_value: str, right_value: str,
                          keys: list[str], ts: str) -> DataFrame:
    """Median of |a - p| per series, rows paired by *position* in time order."""
    a = series_position(left.select(*keys, ts, F.col(left_value).alias("_a")), keys, ts, "_pos")
    b = series_position(right.select(*keys, ts, F.col(right_value).alias("_b")), keys, ts, "_pos")
    paired = a.drop(ts).join(b.drop(ts), keys + ["_pos"])
    return paired.groupBy(*keys).agg(F.median(F.abs(F.col("_a") - F.col("_b"))).alias("medae"))


# ---- anomalies -----------------------------------------------------------------------------

def take_window(predictions: DataFrame, size: int | None, keys: list[str], ts: str,
                take: str = "last") -> DataFrame:
    """First or last ``size`` predictions of each series."""
    if take not in ("first", "last"):
        raise ValueError("take must be 'first' or 'last'")
    if size is None:
        return predictions
    by = F.col(ts).asc() if take == "first" else F.col(ts).desc()
    w = Window.partitionBy(*keys).orderBy(by)
    return predictions.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= size).drop("_k")


def detect_anomalies(predictions: DataFrame, actual: DataFrame, keys: list[str], ts: str,
                     size: int | None = None, take: str = "last", predicted_col: str = "forecast",
                     value_col: str = "z", positional: bool = False) -> DataFrame:
    """Flag bins whose actual value exceeds a robust moving threshold.

    threshold = rolling median of four predictions + FACTOR * median absolute error. Actual values
    attach by time and a missing one counts as 0, the mean of standardised data. The error pairs by
    time; ``positional`` pairs row n of the actual series with row n of the predictions instead.
    """
    taken = take_window(predictions.select(*keys, ts, F.col(predicted_col).alias("fittedvalues")),
                        size, keys, ts, take)
    truth = actual.select(*keys, ts, F.col(value_col).alias("_actual"))
    joined = taken.join(truth, keys + [ts], "left")
    if positional:
        err = median_absolute_error(truth, taken, "_actual", "fittedvalues", keys, ts)
        joined = joined.join(err, keys, "left").withColumnRenamed("medae", "_medae")
    else:
        joined = joined.withColumn("_medae", F.median(
            F.abs(F.col("_actual") - F.col("fittedvalues"))).over(Window.partitionBy(*keys)))
    rolled = rolling_median(joined, "fittedvalues", 4, keys, ts, "median_values")
    return (rolled.withColumn("threshold", F.col("median_values") + F.lit(FACTOR) * F.col("_medae"))
            .withColumn("actualvalues", F.coalesce("_actual", F.lit(0.0)))
            .withColumn("anomaly", (F.col("actualvalues") > F.col("threshold")).cast("int"))
            .select(*keys, ts, "fittedvalues", "median_values", "threshold", "anomaly",
                    "actualvalues"))


def constant_threshold(predictions: DataFrame, medae: DataFrame, keys: list[str],
                       predicted_col: str = "forecast") -> DataFrame:
    """Full-window variant: median of all predictions + FACTOR * median absolute error."""
    line = predictions.groupBy(*keys).agg(F.median(predicted_col).alias("median_value"))
    return line.join(medae, keys).withColumn(
        "threshold", F.col("median_value") + F.lit(FACTOR) * F.col("medae"))


def reporting_window(df: DataFrame, ts: str, timeframe: str, end: Column | None = None) -> DataFrame:
    """Rows in ``[end - timeframe, end]``; ``end`` defaults to the newest row. Unknown names fail."""
    hours = REPORT_HOURS[timeframe]
    end = df.agg(F.max(ts)).scalar() if end is None else end
    return df.where((F.col(ts) >= end - F.expr(f"INTERVAL {hours} hours")) & (F.col(ts) <= end))


def trend_chart(series: DataFrame, timeframe: str, marker: Column, sentiment: str = "sentiment",
                ts: str = "ts_bin", value: str = "cnt") -> DataFrame:
    """Positive and negative counts in the reporting window, with each class's whole-series median
    line and a flag for the span after the ``marker`` instant."""
    both = series.where(F.col(sentiment).isin(1, -1))
    lined = both.withColumn("median_line", F.median(value).over(Window.partitionBy(sentiment)))
    return reporting_window(lined, ts, timeframe).withColumn("after_marker", F.col(ts) >= marker)


def anomaly_chart(flags: DataFrame, forecasts: DataFrame, tail: DataFrame, params: DataFrame,
                  keys: list[str], ts: str) -> DataFrame:
    """Long chart data ``(keys..., ts, series, y)`` in original units.

    Series: actual, predicted, anomaly (flagged actuals), forecast and test (rows after the window).
    """
    def part(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.select(*keys, ts, F.lit(name).alias("series"), F.col(column).alias("_y"))

    stacked = (part(flags, "actualvalues", "actual")
               .unionByName(part(flags, "fittedvalues", "predicted"))
               .unionByName(part(flags.where("anomaly = 1"), "actualvalues", "anomaly"))
               .unionByName(part(forecasts, "forecast", "forecast"))
               .unionByName(part(tail, "z", "test")))
    return unscale(stacked, params, "_y", keys, "y").drop("_y")
