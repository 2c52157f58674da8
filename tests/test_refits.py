"""Searched orders and sliding refits against models fitted one by one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_series import STEP, series, simulate
from tidegauge.operators import forecast as M, refit as R
from tidegauge.plans import anomaly

START = pd.Timestamp("2024-01-01")
BIN = pd.Timedelta(minutes=10)


def mixed(spark):
    """Series that want different orders, one of them differenced, and one too short for any."""
    values = {"ar2": simulate([0.5, 0.3], [], 400, 31), "noise": simulate([], [], 300, 32, 5.0),
              "walk": np.cumsum(simulate([0.6], [], 350, 33)), "ma": simulate([], [0.7], 400, 34), "short": [1.0, 2.0]}
    frames = [series(spark, v, k) for k, v in values.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return values, out


ORDERS = {"ar2": (2, 0, 0), "noise": (0, 0, 0), "walk": (1, 1, 0), "ma": (0, 0, 1), "short": (1, 0, 0)}


def models_of(spark, df):
    """Each series fitted alone with its own order."""
    found = [M.fit_arima(df.where(F.col("k") == k), "y", ["k"], "ts", o, long_order=7) for k, o in ORDERS.items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def test_each_series_is_forecast_with_its_own_order(spark):
    values, df = mixed(spark)
    models = models_of(spark, df)
    got = M.forecast(df, models, "y", ["k"], "ts", STEP, None, 5, widest=(2, 1, 1)).toPandas()
    fitted = M.fitted_values(df, models, "y", ["k"], "ts", widest=(2, 1, 1)).toPandas()
    for k, order in ORDERS.items():
        own = df.where(F.col("k") == k)
        model = models.where(F.col("k") == k)
        want = M.forecast(own, model, "y", ["k"], "ts", STEP, order, 5, long_order=7).toPandas()
        mine = got[got.k == k].sort_values("step")
        assert np.allclose(mine.forecast.astype(float), want.sort_values("step").forecast.astype(float), equal_nan=True), k
        assert list(mine.ts) == list(want.sort_values("step").ts)
        assert mine.forecast.isna().all() == (k == "short")
        want = M.fitted_values(own, model, "y", ["k"], "ts", order, long_order=7).toPandas().sort_values("ts")
        mine = fitted[fitted.k == k].sort_values("ts")
        if k == "short":  # no order, no lags to look for
            assert not len(mine)
            continue
        assert list(mine.ts) == list(want.ts)
        assert np.allclose(mine.fitted.astype(float), want.fitted.astype(float), equal_nan=True), k


def test_no_forecast_is_null_where_a_model_was_found(spark):
    values, df = mixed(spark)
    models = M.build_model(df, "y", ["k"], "ts", 2, 1)
    rows = M.forecast(df, models, "y", ["k"], "ts", STEP, None, 3, widest=(2, 1, 1)).toPandas()
    found = {r.k: (r.p, r.d, r.q) for r in models.collect()}
    assert len({o for o in found.values() if o[0] is not None}) > 1 and found["walk"][1] == 1
    for k, part in rows.groupby("k"):
        assert part.forecast.isna().all() == (found[k][0] is None) and len(part) == 3


def brute_window(part, order, long_order):
    """Forecasts of one window by least squares on explicit rows; none where nothing can be fitted."""
    p, d, q = order
    w, ends = np.array(part, float), []
    for _ in range(d):
        ends.append(w[-1])
        w = np.diff(w)
    e = np.full(len(w), np.nan)

    def solve(rows, y):
        if len(y) <= rows.shape[1]:
            return None
        return np.linalg.lstsq(rows, y, rcond=None)[0]
    if q:
        far = min(long_order, max(1, (len(w) - 4) // 4))
        at = np.arange(far, len(w))
        x = np.column_stack([np.ones(len(at))] + [w[at - k] for k in range(1, far + 1)])
        e[at] = w[at] - x @ solve(x, w[at])
    at = np.array([t for t in range(len(w)) if t >= p and t >= q and not np.isnan(e[t - q:t]).any()])
    x = np.column_stack([np.ones(len(at))] + [w[at - k] for k in range(1, p + 1)] + [e[at - k] for k in range(1, q + 1)])
    coef = solve(x, w[at])
    lags, errors, out = list(w[::-1][:p]), list(e[::-1][:q]), []
    for _ in range(max(p, q, 1)):
        nxt = coef[0] + np.dot(coef[1:1 + p], lags) + np.dot(coef[1 + p:], errors)
        out.append(nxt)
        lags, errors = [nxt, *lags][:p], [0.0, *errors][:q]
    for end in reversed(ends):
        out = list(end + np.cumsum(out))
    return out


def refits(spark, values, order, window, total, share, chunk=None):
    df = series(spark, values)
    got = R.sliding_forecasts(df, "y", ["k"], "ts", STEP, order, window, total, share)
    return {(r.window_id, r.step): (r.forecast, r.ts) for r in got.collect()}


@pytest.mark.parametrize("chunk", [1024, 13])
@pytest.mark.parametrize("order", [(0, 0, 0), (1, 0, 0), (3, 0, 0), (1, 1, 0), (2, 2, 0), (0, 0, 1), (2, 1, 2)])
@pytest.mark.parametrize("level", [0.0, 1e9])
def test_windows_equal_fits_one_by_one(spark, monkeypatch, order, level, chunk):
    """Chunks smaller than the horizon cut it into many; a high level must not cost digits."""
    monkeypatch.setattr(R, "CHUNK", chunk)
    y, window, total = simulate([0.5, 0.2], [0.3], 200, 41), 40, 60
    lags, base = max(order[0], order[2], 1), int(0.7 * 200)
    got = refits(spark, y + level, order, window, total, 0.7)
    assert set(got) == {(w, s) for w in range(-(-total // lags)) for s in range(1, lags + 1)}
    for w in range(-(-total // lags)):
        end = base + w * lags
        want = brute_window(y[end - window:end], order, sum((order[0], order[2], 4)))
        for s in range(1, lags + 1):
            value, ts = got[w, s]
            assert value - level == pytest.approx(want[s - 1], abs=1e-4 if level else 1e-9)
            assert ts == START + (end - 1 + s) * BIN


def test_windows_at_the_edges(spark):
    """Windows before the first row, past the last one, over holes and over nothing but holes."""
    y = simulate([0.5], [], 30, 42)
    got = refits(spark, y, (1, 0, 0), 40, 30, 0.5)  # each window begins before the series does
    assert len(got) == 30
    for (w, _), (value, ts) in got.items():
        part = y[max(0, w - 25):min(15 + w, 30)]
        assert value == pytest.approx(brute_window(part, (1, 0, 0), 5)[0])
        assert ts == START + min(15 + w, 30) * BIN
    past = refits(spark, y, (1, 0, 0), 10, 14, None)  # ends run past the last row, until no row is left
    assert set(past) == {(w, 1) for w in range(10)}
    assert past[9, 1][0] is None and past[0, 1][0] is not None  # one row cannot be fitted
    rows = [(i, None if 10 <= i < 20 else float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame([("s", (START + i * BIN).to_pydatetime(), v) for i, v in rows],
                               "k string, ts timestamp_ntz, y double")
    got = {r.window_id: r for r in R.sliding_forecasts(df, "y", ["k"], "ts", STEP, (1, 0, 0), 8, 20, 1 / 3).collect()}
    assert len(got) == 20
    assert got[0].forecast == pytest.approx(brute_window(y[2:10], (1, 0, 0), 5)[0])
    assert got[4].ts == (START + 10 * BIN) and got[4].forecast == pytest.approx(brute_window(y[6:10], (1, 0, 0), 5)[0])
    assert got[8].forecast is None and got[8].ts is None  # nothing but a hole
    assert got[12].forecast is None and got[12].ts == START + 22 * BIN  # two rows after it


def test_refits_take_the_order_of_each_series(spark):
    values, df = mixed(spark)
    orders = spark.createDataFrame([(k, *o) for k, o in ORDERS.items()] + [(None, 1, 0, 0)], "k string, p int, d int, q int")
    both = df.unionByName(series(spark, values["ar2"], None).withColumn("k", F.lit(None).cast("string")))
    got = M.generate_forecasts(both, "y", ["k"], "ts", STEP, orders, 60, 20, 0.8).toPandas()
    for k, order in [*ORDERS.items(), (None, (1, 0, 0))]:
        part = got[got.k.isna()] if k is None else got[got.k == k]
        lags = max(order[0], order[2], 1)
        y = values[k or "ar2"]
        if k == "short":
            assert part.forecast.isna().all()
            continue
        assert len(part) == -(-20 // lags) * lags
        for r in part.itertuples():
            end = int(0.8 * len(y)) + r.window_id * lags
            assert r.forecast == pytest.approx(brute_window(y[end - 60:end], order, order[0] + order[2] + 4)[r.step - 1], abs=1e-6)


def test_rows_are_copied_twice_at_most(spark):
    df = series(spark, simulate([0.5], [], 3000, 43))
    out = R.sliding_forecasts(df, "y", ["k"], "ts", STEP, (1, 0, 0), 144, 800, 0.73)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") <= 1
    assert out.count() == 800
    # of a chunk of 1024 window ends and 144 rows before it, no row is dealt more than twice
    generated = [m for m in plan.split("\n") if "Generate explode" in m]
    assert len(generated) == 1


def test_training_searches_where_no_order_is_given(spark):
    a, b = simulate([0.8], [], 300, 44), np.cumsum(simulate([], [], 300, 45))
    both = series(spark, a, "1").unionByName(series(spark, b, "2")).withColumnsRenamed({"k": "sentiment", "ts": "ts_bin", "y": "z"})
    both = both.withColumn("cnt", F.col("z"))
    trained = anomaly.train(both, None, 40)
    found = {r.sentiment: (r.p, r.d, r.q) for r in trained.models.collect()}
    assert found["1"] != found["2"] and found["2"][1] == 1
    assert trained.forecasts.where("forecast IS NULL").count() == 0
    flags = anomaly.infer(both, trained.forecasts, trained.models, None)
    assert flags.where("fittedvalues IS NULL").count() == 0
    assert flags.groupBy("sentiment").count().count() == 2
