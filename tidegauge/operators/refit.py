"""Sliding refits: a model per window of a series, each fitted on its own rows and forecasting ahead.

Rows are dealt to chunks of window ends, each with the rows that its first window reaches back to, so
a row is copied at most twice however much windows overlap. Inside a chunk an autoregression's product
matrices come from cumulative outer products: a window's matrix is the difference of two of them, and
all windows are solved together. Values are taken less the chunk's mean and over its deviation first,
so the differences lose nothing on a high level. Moving-average terms need residuals of a long
autoregression of the window itself and are fitted window by window on slices of the chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidegauge.operators.joins import null_safe_join
from tidegauge.operators.timeseries import series_position

#: Window ends per chunk, where windows are shorter than that.
CHUNK = 1024


def _back(x: np.ndarray, n: int) -> np.ndarray:
    """Row t holds x[t-1], ..., x[t-n]; not a number before the start."""
    out = np.full((len(x), n), np.nan)
    for k in range(1, n + 1):
        out[k:, k - 1] = x[:-k or None][:max(0, len(x) - k)]
    return out


def _solved(m: np.ndarray) -> np.ndarray:
    """Least squares of the last column on the others for a stack of product matrices."""
    k = m.shape[1] - 1
    size = np.sqrt(np.maximum(np.diagonal(m, axis1=1, axis2=2)[:, :k], 1e-300))
    xtx = m[:, :k, :k] / (size[:, :, None] * size[:, None, :])
    return (np.linalg.pinv(xtx, rcond=k * 1e-15, hermitian=True) @ (m[:, :k, k] / size)[:, :, None])[:, :, 0] / size


def _fit_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Coefficients, constant first, or None where there are too few rows."""
    if len(y) <= x.shape[1] + 1:
        return None
    mean, scale = y.mean(), y.std() or 1.0
    rows = np.c_[np.ones(len(y)), x, (y - mean) / scale]
    coef = _solved((rows.T @ rows)[None])[0] * scale
    coef[0] += mean
    return coef


def _autoregressions(w: np.ndarray, p: int, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per window ``[first, end)``: constant and ``p`` weights, not a number with too few rows."""
    seen = np.isfinite(w)
    mean = w[seen].mean() if seen.any() else 0.0
    scale = (w[seen].std() if seen.any() else 0.0) or 1.0
    z = (w - mean) / scale
    rows = np.c_[np.ones(len(z)), _back(z, p), z]
    rows[~np.isfinite(rows).all(axis=1)] = 0.0
    sums = np.concatenate([np.zeros((1, p + 2, p + 2)), np.cumsum(rows[:, :, None] * rows[:, None, :], axis=0)])
    m = sums[ends] - sums[np.minimum(first + p, ends)]
    n = np.rint(m[:, 0, 0])
    coef = np.full((len(ends), p + 1), np.nan)
    enough = n > p + 1
    if enough.any():
        coef[enough] = _solved(m[enough])
        coef[:, 0] = coef[:, 0] * scale + mean * (1 - coef[:, 1:].sum(axis=1))
    return coef


def _with_averages(w: np.ndarray, p: int, q: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Constant, ``p`` and ``q`` weights of one window in two stages, and the innovations."""
    far = min(far, max(1, (int(np.isfinite(w).sum()) - 4) // 4))
    coef, e = np.full(1 + p + q, np.nan), np.full(len(w), np.nan)
    lags = _back(w, max(p, far))
    use = np.isfinite(w) & np.isfinite(lags[:, :far]).all(axis=1)
    long = _fit_rows(lags[use, :far] - np.nanmean(w), w[use]) if use.any() else None
    if long is not None:
        e[use] = w[use] - long[0] - (lags[use, :far] - np.nanmean(w)) @ long[1:]
        x = np.c_[lags[:, :p], _back(e, q)]
        use = np.isfinite(w) & np.isfinite(x).all(axis=1)
        if use.any():
            centre = np.r_[np.full(p, np.nanmean(w)), np.zeros(q)]
            found = _fit_rows(x[use] - centre, w[use])
            if found is not None:
                coef = np.r_[found[0] - centre @ found[1:], found[1:]]
    return coef, e


def forecast_windows(y: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: tuple[int, int, int],
                     steps: int, long_order: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For windows ``[start, end)`` of ``y`` (not a number: missing): position of the last value, -1 if
    there is none, and ``steps`` forecasts, not a number where nothing can be fitted or a lag is missing."""
    p, d, q = order
    levels, w = [], y.astype(float)
    for _ in range(d):
        levels.append(w)
        w = np.r_[np.nan, w[1:] - w[:-1]]
    first = np.minimum(starts + d, ends)  # differences of the window itself
    at = np.maximum.accumulate(np.where(np.isfinite(w), np.arange(len(w)), -1))[ends - 1]
    at = np.where(at >= first, at, -1)
    lags = at[:, None] - np.arange(max(p, q))
    inside = (lags >= first[:, None]) & (at >= 0)[:, None]
    newest = np.where(inside, w[np.where(inside, lags, 0)], np.nan)[:, :p]
    errors = np.zeros((len(ends), q))
    if q == 0:
        coef = _autoregressions(w, p, first, ends)
    else:
        coef = np.empty((len(ends), 1 + p + q))
        for i, (a, b) in enumerate(zip(first, ends)):
            coef[i], e = _with_averages(w[a:b], p, q, long_order or p + q + 4)
            own = at[i] - np.arange(q) - a
            errors[i] = np.where(own >= 0, e[np.maximum(own, 0)], np.nan) if at[i] >= 0 else np.nan
    out = np.empty((len(ends), steps))
    for s in range(steps):
        out[:, s] = coef[:, 0] + (coef[:, 1:1 + p] * newest).sum(axis=1) + (coef[:, 1 + p:] * errors).sum(axis=1)
        newest = np.c_[out[:, s], newest][:, :p]
        errors = np.c_[np.zeros(len(ends)), errors][:, :q]
    out[at < 0] = np.nan
    for level in reversed(levels):
        out = level[at][:, None] + np.cumsum(out, axis=1)
    return at, out


def sliding_forecasts(series: DataFrame, value: str, keys: list[str], ts: str, freq: str,
                      order: tuple[int, int, int] | DataFrame, window: int, total: int,
                      train_share: float | None = None, long_order: int | None = None) -> DataFrame:
    """``keys, window_id, step, ts, forecast`` of every sliding refit of every series.

    Window w covers positions [end - window, end) with end = base + w * lags, where base is the series
    length or the training share of it and lags = max(p, q, 1): it is fitted on its rows and forecasts
    that many steps. ``order`` is one (p, d, q) or a table with a row ``keys, p, d, q`` per series (nulls
    count as 0); series that it lacks have no window. Forecasts are null where a window's model cannot
    be fitted or a lag is missing.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    base = size if train_share is None else F.floor(F.lit(train_share) * size)
    rows = series_position(series.select(*keys, ts, F.col(value).cast("double").alias("_y")), keys, ts, "_pos").select(
        *keys, F.col(ts).alias("_ts"), "_y", (F.col("_pos") - base).cast("long").alias("_gap"))
    terms = ["_p", "_d", "_q"]
    if isinstance(order, tuple):
        rows = rows.withColumns({t: F.lit(n) for t, n in zip(terms, order)})
    else:
        own = order.select(*keys, *(F.coalesce(F.col(t[1:]), F.lit(0)).cast("int").alias(t) for t in terms))
        rows = null_safe_join(rows, own, list(keys))
    chunk = max(window, CHUNK)
    rows = rows.withColumn("_lags", F.greatest("_p", "_q", F.lit(1)))
    last = (F.ceil(F.lit(total) / F.col("_lags")) - 1) * F.col("_lags")  # offset of the last window's end
    rows = rows.withColumn("_from", F.greatest(F.lit(0), F.floor((F.col("_gap") + 1) / chunk))).withColumn(
        "_to", F.least(F.floor(last / chunk), F.floor((F.col("_gap") + window) / chunk)))
    dealt = rows.where("_from <= _to").withColumn("_chunk", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
    names = list(keys)
    schema = T.StructType([dealt.schema[k] for k in names] + [
        T.StructField("window_id", T.LongType()), T.StructField("step", T.IntegerType()),
        T.StructField("_ts", dealt.schema["_ts"].dataType), T.StructField("forecast", T.DoubleType())])

    def refit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_gap")
        one, gap0 = part.iloc[0], int(part["_gap"].iloc[0])
        p, d, q, lags, c = (int(one[n]) for n in ("_p", "_d", "_q", "_lags", "_chunk"))
        ids = np.arange(-(-c * chunk // lags), min(-(-total // lags) - 1, ((c + 1) * chunk - 1) // lags) + 1)
        ends = np.minimum(ids * lags - gap0, len(part))
        starts = np.maximum(ids * lags - gap0 - window, 0)
        ids, starts, ends = (x[starts < ends] for x in (ids, starts, ends))
        out = pd.DataFrame(index=range(len(ids) * lags), columns=schema.names)
        if len(ids):
            at, found = forecast_windows(part["_y"].to_numpy(float), starts, ends, (p, d, q), lags, long_order)
            times = part["_ts"].take(np.maximum(at, 0)).where(at >= 0)
            out["window_id"], out["step"] = np.repeat(ids, lags), np.tile(np.arange(1, lags + 1), len(ids))
            out["_ts"] = times.repeat(lags).to_numpy()
            out["forecast"] = pd.Series(found.ravel()).where(np.isfinite(found.ravel()), None)
            for k in names:
                out[k] = [one[k]] * len(out)
        return out
    found = dealt.groupBy(*names, "_chunk").applyInPandas(refit, schema)
    return found.select(*names, "window_id", "step",
                        (F.col("_ts") + F.col("step") * F.expr(f"INTERVAL {freq}")).alias(ts), "forecast")
