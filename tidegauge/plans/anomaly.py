"""Events to anomaly flags: preparation, training and inference as lazy plans."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tidegauge.operators.forecast import adf, build_model, fit_arima, forecast, generate_forecasts
from tidegauge.operators.stats import detect_anomalies, standardise
from tidegauge.operators.timeseries import resample_counts
from tidegauge.session import spool

# Bin width, sliding window (bins), training window of inference (bins),
# season (bins), training share, forecast steps.
BIN = "10 minutes"
SLIDING_WINDOW = 144
TRAINING_WINDOW = 1440
SEASON = 24
TRAINING_SHARE = 0.73
FUTURE_STEPS = 2


def prepare(events: DataFrame, ts: str = "ts", key: str = "sentiment",
            freq: str = BIN) -> DataFrame:
    """Zero-filled, standardised count series per class: ``key, ts_bin, cnt, z``."""
    return standardise(resample_counts(events.select(ts, key), ts, freq, [key]), "cnt", [key])


def flag(series: DataFrame, predictions: DataFrame, key: str = "sentiment",
         size: int = TRAINING_WINDOW) -> DataFrame:
    """Flags for the last ``size`` predictions of every class."""
    return detect_anomalies(predictions, series, [key], "ts_bin", size, "last")


class Training(NamedTuple):
    """What training leaves behind: unit-root tests, models, stored forecasts, flags."""
    tests: DataFrame
    models: DataFrame
    forecasts: DataFrame
    flags: DataFrame


def train(series: DataFrame, order: tuple[int, int, int] | DataFrame | None, total: int, key: str = "sentiment",
          size: int = TRAINING_WINDOW, prior: DataFrame | None = None) -> Training:
    """Test and fit every class of a prepared series, forecast from the end of the training share by
    sliding refits, and flag what was forecast. Earlier forecasts, if given, come first.

    ``order`` is one for all classes, or the models of an order search, of which every class takes its
    own; without it the orders are searched here.
    """
    keys = [key]
    if order is None:
        order = spool(build_model(series, "z", keys, "ts_bin"))  # read by the refits, and kept
    predicted = generate_forecasts(series, "z", keys, "ts_bin", BIN, order, SLIDING_WINDOW, total,
                                   TRAINING_SHARE).select(key, "ts_bin", "forecast")
    if prior is not None:
        ended = prior.groupBy(key).agg(F.max("ts_bin").alias("_last"))
        newer = predicted.join(ended, key, "left").where("_last IS NULL OR ts_bin > _last").drop("_last")
        predicted = prior.select(key, "ts_bin", "forecast").unionByName(newer)
    models = fit_arima(series, "z", keys, "ts_bin", order) if isinstance(order, tuple) else order
    return Training(adf(series, "z", keys, "ts_bin"), models, predicted, flag(series, predicted, key, size))


def infer(series: DataFrame, stored: DataFrame, models: DataFrame, order: tuple[int, int, int] | None,
          key: str = "sentiment", steps: int = FUTURE_STEPS, size: int = TRAINING_WINDOW) -> DataFrame:
    """Flags from stored forecasts up to their last bin and, after it, forecasts of stored models
    that start at the end of the series; without ``order`` each model follows its own."""
    last = stored.groupBy(key).agg(F.max("ts_bin").alias("_last"))
    ahead = forecast(series, models, "z", [key], "ts_bin", BIN, order, steps)
    newer = ahead.join(last, key, "left").where("_last IS NULL OR ts_bin > _last")
    every = stored.select(key, "ts_bin", "forecast").unionByName(newer.select(key, "ts_bin", "forecast"))
    return flag(series, every, key, size)
