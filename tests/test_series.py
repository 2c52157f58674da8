"""Series operators: invariants, edge cases, pandas and NumPy as brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import forecast as M, stats as S, timeseries as W

STEP = "10 minutes"


def series(spark, values, key="s", start="2024-01-01"):
    ts = pd.date_range(start, periods=len(values), freq="10min")
    pdf = pd.DataFrame({"k": key, "ts": ts, "y": [float(v) for v in values]})
    return spark.createDataFrame(pdf, "k string, ts timestamp_ntz, y double")


def collect(df, column, *by):
    return [r[column] for r in df.orderBy(*(by or ("ts",))).collect()]


@pytest.fixture(scope="module")
def events(spark):
    """Skewed events: a third in one bin, one class with a gap of days, null class and null time."""
    rng = np.random.default_rng(3)
    base = pd.Timestamp("2024-03-01")
    rows = [("hot", base + pd.Timedelta(minutes=3, seconds=i % 300)) for i in range(400)]
    rows += [(f"c{rng.integers(0, 3)}", base + pd.Timedelta(minutes=int(rng.integers(0, 900))))
             for _ in range(800)]
    rows += [("gap", base), ("gap", base + pd.Timedelta(days=3)), (None, base), ("gap", None)]
    pdf = pd.DataFrame(rows, columns=["c", "ts"])
    return pdf, spark.createDataFrame(
        [(c, None if pd.isna(t) else t.to_pydatetime()) for c, t in rows],
        "c string, ts timestamp_ntz")


def test_resample_equals_pandas(events):
    pdf, df = events
    got = W.resample_counts(df, "ts", STEP, ["c"]).toPandas().set_index(["c", "ts_bin"]).cnt
    for c, part in pdf.dropna().groupby("c"):
        ref = part.set_index("ts").resample("10min").size()
        assert got[c].sort_index().tolist() == ref.tolist()
        assert got[c].sum() == len(part)
        assert len(got[c]) == (ref.index[-1] - ref.index[0]) / pd.Timedelta("10min") + 1


def test_common_span(events):
    _, df = events
    got = W.resample_counts(df, "ts", STEP, ["c"], common_span=True).groupBy("c").agg(
        F.count("*").alias("n"), F.min("ts_bin").alias("lo")).collect()
    assert len({(r.n, r.lo) for r in got}) == 1


def test_empty_and_single_bin(spark, events):
    _, df = events
    assert W.resample_counts(df.where("c = 'none'"), "ts", STEP, ["c"]).count() == 0
    one = W.resample_counts(df.where("c = 'hot'"), "ts", STEP, ["c"])
    assert [r.cnt for r in one.collect()] == [400]
    z = S.standardise(one, "cnt", ["c"])
    assert [r.z for r in z.collect()] == [0.0]


def test_rolling_median(spark):
    values = [5, 1, 4, 2, 8, 8, 0]
    got = collect(W.rolling_median(series(spark, values), "y", 4, ["k"], "ts", "m"), "m")
    assert got == pd.Series(values, dtype=float).rolling(4).median().fillna(0).tolist()


def test_constant_series(spark):
    df = series(spark, [3] * 6)
    assert collect(S.standardise(df, "y", ["k"]), "z") == [0.0] * 6
    params = S.fit_standard(df, "y", ["k"])
    back = S.unscale(S.scale(df, params, "y", ["k"], "z"), params, "z", ["k"], "b")
    assert collect(back, "b") == [3.0] * 6
    assert collect(S.acf(df, "y", ["k"], "ts", 3), "acf", "lag") == [1.0, None, None, None]


def test_scaling_round_trip_without_keys(spark):
    df = series(spark, [1, 2, 3, 10])
    for fit in (S.fit_standard, S.fit_min_max):
        params = fit(df, "y", [])
        back = S.unscale(S.scale(df, params, "y", [], "z"), params, "z", [], "b")
        assert collect(back, "b") == pytest.approx([1, 2, 3, 10])


@pytest.mark.parametrize("n", [0, 1, 4, 7, 10, 23])
def test_rotation(spark, n):
    values = list(range(7))
    df = series(spark, values)
    got = W.next_rolling_window(df, n, ["k"], "ts", "y", STEP)
    k = n % 7
    assert collect(got, "y") == [float(v) for v in values[k:] + values[:k]]
    first = got.agg(F.min("ts")).first()[0]
    assert first == pd.Timestamp("2024-01-01") + n * pd.Timedelta("10min")


def test_lag_frames_options(spark):
    df = series(spark, range(10))
    got = W.lag_frames(df, "y", 4, ["k"], "ts", stride=3, sampling_rate=2, start_index=1,
                       reverse=True).orderBy("pos").collect()
    assert [(r.pos, r.frame, r.target) for r in got] == [(5, [3.0, 1.0], 5.0), (8, [6.0, 4.0], 8.0)]
    assert W.lag_frames(df, "y", 4, ["k"], "ts", end_index=5).count() == 2


def test_trailing_sums_are_inclusive(spark):
    bins = series(spark, range(1, 11)).select(F.col("ts").alias("ts_bin"),
                                              F.col("y").cast("long").alias("cnt"))
    assert tuple(W.trailing_sums(bins, [1, 10, 60]).first()) == (10, 19, 49)
    empty = W.trailing_sums(bins.where("cnt > 99"), [1, 10, 60]).first()
    assert tuple(empty) == (0, 0, 0)


def test_summary_flag_of_last_bin(spark):
    bins = series(spark, [1, 2]).select(F.col("ts").alias("ts_bin"), F.col("y").cast("long").alias("cnt"))
    flags = bins.select("ts_bin", (F.col("cnt") - 1).cast("int").alias("anomaly"))
    row = W.summary_row(bins, flags).first()
    assert row.anomaly_found is False and row.last_bin_anomaly is True


def test_decomposition_adds_up(spark):
    t = np.arange(96)
    y = 0.1 * t + np.sin(2 * np.pi * t / 12) + 5
    for period in (12, 7):
        got = S.decompose(series(spark, y), "y", period, ["k"], "ts").toPandas()
        whole = got.dropna()
        assert len(whole) == 96 - 2 * (period // 2)
        assert np.allclose(whole.trend + whole.seasonal + whole.resid, whole.y)
        assert abs(got.seasonal[:period].sum()) < 1e-9
    assert S.decompose(series(spark, y), "y", 12, ["k"], "ts").agg(
        F.max(F.abs("resid"))).first()[0] < 1e-9


def test_pacf_against_yule_walker(spark):
    rng = np.random.default_rng(5)
    y = np.zeros(400)
    for i in range(2, 400):
        y[i] = 0.5 * y[i - 1] - 0.3 * y[i - 2] + rng.normal()
    df = series(spark, y)
    r = np.array(collect(S.acf(df, "y", ["k"], "ts", 6), "acf", "lag"))
    assert r[0] == 1 and np.all(np.abs(r) <= 1)
    want = [1.0]
    for k in range(1, 7):
        mat = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        want.append(np.linalg.solve(mat, r[1:k + 1])[-1])
    assert collect(S.pacf(df, "y", ["k"], "ts", 6), "pacf", "lag") == pytest.approx(want)


@pytest.mark.parametrize("take", ["first", "last"])
@pytest.mark.parametrize("positional", [False, True])
def test_anomaly_flags_equal_pandas(spark, take, positional):
    rng = np.random.default_rng(8)
    actual = rng.normal(size=60)
    actual[[20, 45]] += 9
    pred = np.roll(actual, 1)[1:] * 0.5
    a = series(spark, actual)
    p = series(spark, pred, start="2024-01-01 00:10:00").withColumnRenamed("y", "forecast")
    got = S.detect_anomalies(p, a, ["k"], "ts", 40, take, "forecast", "y", positional).toPandas()
    got = got.sort_values("ts").reset_index(drop=True)
    ps = pd.Series(pred)[:40] if take == "first" else pd.Series(pred)[-40:]
    truth = pd.Series(actual)[ps.index + 1].to_numpy()
    pairs = actual[:40] if positional else truth
    threshold = ps.rolling(4).median().fillna(0) + 1.6448536269514722 / 0.67449 * np.median(
        np.abs(pairs - ps.to_numpy()))
    assert np.allclose(got.threshold, threshold) and np.allclose(got.actualvalues, truth)
    assert (got.anomaly == (got.actualvalues > got.threshold)).all()
    assert got.anomaly.tolist() == (truth > threshold).astype(int).tolist()


def test_missing_actual_counts_as_zero(spark):
    p = series(spark, [1, 1, 1]).withColumnRenamed("y", "forecast")
    a = series(spark, [1])
    got = S.detect_anomalies(p, a, ["k"], "ts", None, value_col="y").orderBy("ts").collect()
    assert [r.actualvalues for r in got] == [1.0, 0.0, 0.0]


def test_unknown_timeframe_and_take(spark):
    df = series(spark, [1])
    with pytest.raises(KeyError):
        S.reporting_window(df, "ts", "month")
    with pytest.raises(ValueError):
        S.take_window(df, 1, ["k"], "ts", "middle")


# ---- fits ----------------------------------------------------------------------------------

def simulate(phi, theta, n, seed, const=0.0):
    rng = np.random.default_rng(seed)
    e, y = rng.normal(size=n), np.zeros(n)
    for i in range(n):
        y[i] = const + e[i]
        y[i] += sum(p * y[i - j - 1] for j, p in enumerate(phi) if i > j)
        y[i] += sum(q * e[i - j - 1] for j, q in enumerate(theta) if i > j)
    return y


def test_ar_fit_equals_least_squares(spark):
    y = simulate([0.6, -0.2], [], 500, 1, 0.5)
    m = M.fit_arima(series(spark, y), "y", ["k"], "ts", (2, 0, 0)).first()
    x = np.column_stack([np.ones(498), y[1:-1], y[:-2]])
    coef = np.linalg.lstsq(x, y[2:], rcond=None)[0]
    assert [m.const, *m.phi] == pytest.approx(coef.tolist()) and m.n == 498
    rss = float(((y[2:] - x @ coef) ** 2).sum())
    assert m.aic == pytest.approx(498 * np.log(rss / 498) + 2 * 4)


def test_arma_recovers_coefficients(spark):
    y = simulate([0.7], [0.4], 6000, 2)
    m = M.fit_arima(series(spark, y), "y", ["k"], "ts", (1, 0, 1)).first()
    assert m.phi[0] == pytest.approx(0.7, abs=0.06) and m.theta[0] == pytest.approx(0.4, abs=0.08)


def test_ma_recovers_coefficient(spark):
    y = simulate([], [0.5], 6000, 9)
    m = M.fit_arima(series(spark, y), "y", ["k"], "ts", (0, 0, 1)).first()
    assert m.theta[0] == pytest.approx(0.5, abs=0.06)


def test_two_series_fit_apart(spark):
    a, b = simulate([0.8], [], 800, 3), simulate([-0.5], [], 800, 4)
    both = series(spark, a, "a").unionByName(series(spark, b, "b"))
    got = {r.k: r.phi[0] for r in M.fit_arima(both, "y", ["k"], "ts", (1, 0, 0)).collect()}
    assert got["a"] == pytest.approx(0.8, abs=0.08) and got["b"] == pytest.approx(-0.5, abs=0.1)


def test_order_search_finds_the_lag(spark):
    y = simulate([0.0, 0.8], [], 1500, 6)
    best = M.build_model(series(spark, y), "y", ["k"], "ts", 3, 1, d=0).first()
    assert best.p >= 2 and best.phi[1] == pytest.approx(0.8, abs=0.1)
    stored = M.fit_arima(series(spark, y), "y", ["k"], "ts", (1, 0, 0))
    assert M.build_model(series(spark, y), "y", ["k"], "ts", stored=stored, rebuild=False) is stored
    with pytest.raises(ValueError):
        M.build_model(series(spark, y), "y", ["k"], "ts", rebuild=False)


def test_order_search_differences_a_random_walk(spark):
    rng = np.random.default_rng(21)
    noise, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    both = series(spark, noise, "noise").unionByName(series(spark, walk, "walk"))
    got = {r.k: r for r in M.build_model(both, "y", ["k"], "ts", 1, 1).collect()}
    assert (got["noise"].d, got["walk"].d) == (0, 1)
    level = M.build_model(series(spark, walk, "walk"), "y", ["k"], "ts", 1, 1, d=1).first()
    assert (got["walk"].p, got["walk"].q, got["walk"].n) == (level.p, level.q, level.n)
    assert got["walk"].aic == pytest.approx(level.aic)


def test_unit_root_decisions(spark):
    rng = np.random.default_rng(11)
    noise, walk = rng.normal(size=600), np.cumsum(rng.normal(size=600))
    both = series(spark, noise, "noise").unionByName(series(spark, walk, "walk"))
    got = {r.k: r for r in M.adf(both, "y", ["k"], "ts").collect()}
    assert got["noise"].stationary and not got["walk"].stationary
    for r in got.values():
        assert r.stationary == (r.p_value < 0.05) == (r.statistic < r.crit_5)
        assert r.crit_1 < r.crit_5 < r.crit_10


def test_adf_statistic_equals_regression(spark):
    y = simulate([0.9], [], 300, 12)
    r = M.adf(series(spark, y), "y", ["k"], "ts").first()
    dy, lag = np.diff(y), r.used_lag
    x = np.column_stack([np.ones(len(dy) - lag), y[lag:-1]] + [
        dy[lag - i - 1:len(dy) - i - 1] for i in range(lag)])
    t = dy[lag:]
    coef = np.linalg.lstsq(x, t, rcond=None)[0]
    res = t - x @ coef
    se = np.sqrt(res @ res / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    assert r.statistic == pytest.approx(coef[1] / se) and r.n_obs == len(t)


def test_forecast_of_a_differenced_line(spark):
    df = series(spark, np.arange(50) * 2.0 + 1)
    models = M.fit_arima(df, "y", ["k"], "ts", (0, 1, 0))
    got = M.forecast(df, models, "y", ["k"], "ts", STEP, (0, 1, 0), 3)
    assert collect(got, "forecast", "step") == pytest.approx([101, 103, 105])
    curve = series(spark, np.arange(30) ** 2.0)
    models = M.fit_arima(curve, "y", ["k"], "ts", (0, 2, 0))
    got = M.forecast(curve, models, "y", ["k"], "ts", STEP, (0, 2, 0), 3)
    assert collect(got, "forecast", "step") == pytest.approx([900, 961, 1024])
    assert got.agg(F.min("ts")).first()[0] == pd.Timestamp("2024-01-01 05:00:00")


def test_fitted_values_are_actual_minus_residual(spark):
    y = np.cumsum(simulate([0.5], [], 200, 13))
    df = series(spark, y)
    models = M.fit_arima(df, "y", ["k"], "ts", (1, 1, 0))
    got = M.fitted_values(df, models, "y", ["k"], "ts", (1, 1, 0)).orderBy("ts").toPandas()
    m = models.first()
    d = np.diff(y)
    want = y[1:-1] + m.const + m.phi[0] * d[:-1]
    assert np.allclose(got.fitted, want)


@pytest.mark.parametrize("order,total,share", [((2, 0, 0), 7, 0.73), ((1, 0, 0), 3, None),
                                               ((0, 0, 0), 2, None)])
def test_sliding_refits_equal_a_loop(spark, order, total, share):
    """The horizon is not a multiple of the lags, windows run past the end, p = q = 0 is guarded."""
    y, window = simulate([0.6, 0.2], [], 120, 14), 40
    got = M.generate_forecasts(series(spark, y), "y", ["k"], "ts", STEP, order, window, total, share)
    got = {(r.window_id, r.step): r.forecast for r in got.collect()}
    lags, base = max(order[0], order[2], 1), int(share * 120) if share else 120
    want = {}
    for w in range(-(-total // lags)):
        end = base + w * lags
        part = list(y[end - window:end])
        p = order[0]
        x = np.array([[1.0] + [part[i - j] for j in range(1, p + 1)] for i in range(p, len(part))])
        coef = np.linalg.lstsq(x, np.array(part[p:]), rcond=None)[0]
        for step in range(1, lags + 1):
            nxt = coef[0] + sum(coef[j] * part[-j] for j in range(1, p + 1))
            part.append(nxt)
            want[(w, step)] = nxt
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value)


def test_refit_plan_matches_windows(spark):
    df = spark.createDataFrame([("s", 100)], "k string, n long")
    plan = W.refit_plan(df, 40, 7, 2).orderBy("window_id").collect()
    assert [(r.start_pos, r.end_pos) for r in plan] == [(60, 100), (62, 102), (64, 104), (66, 106)]
    assert W.refit_plan(df, 40, 3, 0).count() == 3


def _levels(spark, change):
    import random
    from datetime import datetime, timedelta
    rng, rows = random.Random(9), []
    for name, n in (("long", 300), ("mid", 30), ("short", 16), ("flat", 40), ("one", 1)):
        y = 0.0
        for i in range(n):
            y = 0.0 if name == "flat" else 0.6 * y + rng.gauss(0, 1)
            rows.append((name, datetime(2024, 1, 1) + timedelta(hours=i), change(y)))
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, y double")


@pytest.mark.parametrize("scale,shift", [(1.0, 0.0), (1e6, 0.0), (1e-6, 0.0), (1.0, 1e9)])
def test_fits_do_not_depend_on_unit_or_level(spark, scale, shift):
    from tidegauge.operators import forecast as M
    plain, moved = _levels(spark, lambda y: y), _levels(spark, lambda y: y * scale + shift)
    tested = [{r.k: r for r in M.adf(s, "y", ["k"], "ts").collect()} for s in (plain, moved)]
    fitted = [{r.k: r for r in M.fit_arima(s, "y", ["k"], "ts", (2, 0, 1)).collect()} for s in (plain, moved)]
    assert set(tested[0]) == set(fitted[0]) == {"long", "mid", "short", "flat", "one"}
    for k in ("long", "mid", "short"):
        a, b = tested[0][k], tested[1][k]
        assert (a.used_lag, a.n_obs, a.stationary) == (b.used_lag, b.n_obs, b.stationary)
        assert b.statistic == pytest.approx(a.statistic, rel=1e-4)
    a, b = fitted[0]["long"], fitted[1]["long"]
    assert b.phi == pytest.approx(a.phi, abs=1e-4) and b.theta == pytest.approx(a.theta, abs=1e-4)
    assert b.sigma2 == pytest.approx(a.sigma2 * scale ** 2, rel=1e-4)
    assert b["const"] == pytest.approx(a["const"] * scale + shift * (1 - sum(a.phi)), rel=1e-3, abs=1e-3 * scale)
    assert tested[0]["one"].statistic is None and fitted[0]["one"].phi is None


def test_a_series_gives_the_same_row_alone_and_in_company(spark):
    from tidegauge.operators import forecast as M
    series = _levels(spark, lambda y: y)
    tested = {r.k: r for r in M.adf(series, "y", ["k"], "ts").collect()}
    models = {r.k: r for r in M.build_model(series, "y", ["k"], "ts").collect()}
    for k in ("long", "mid", "short", "one"):
        alone = series.where(F.col("k") == k)
        for want, got in ((tested[k], M.adf(alone, "y", ["k"], "ts").first()),
                          (models[k], M.build_model(alone, "y", ["k"], "ts").first())):
            assert [round(v, 9) if isinstance(v, float) else str(v)[:12] for v in want] == [
                round(v, 9) if isinstance(v, float) else str(v)[:12] for v in got]
    assert models["mid"].p is not None and models["short"].p is not None


def test_lags_stop_at_holes(spark):
    from tidegauge.operators import forecast as M
    series = _levels(spark, lambda y: y).where("k = 'long'")
    holed = series.withColumn("y", F.when(F.hour("ts") != 5, F.col("y")))
    rows = M.arma_rows(holed, "y", ["k"], "ts", 2, 0, 0)
    hours = {r.h for r in rows.select(F.hour("ts").alias("h")).distinct().collect()}
    assert hours == set(range(24)) - {5, 6, 7}
    ends = M.forecast(series.withColumn("y", F.when(F.col("ts") < "2024-01-13 10:00:00", F.col("y"))), M.fit_arima(
        series, "y", ["k"], "ts", (1, 0, 0)), "y", ["k"], "ts", "1 hour", (1, 0, 0), 2).collect()
    assert len(ends) == 2 and all(r.forecast is not None for r in ends)


def test_lag_frames_of_features(spark):
    df = spark.createDataFrame([("a", i, float(i), None if i == 5 else 10.0 * i) for i in range(12)], "k string, ts int, y double, z double")
    rows = {r.pos: r for r in W.lag_frames(df, ["y", "z"], 3, ["k"], "ts", shuffle_seed=1).collect()}
    assert sorted(rows) == [3, 4, 5, 9, 10, 11]  # no frame over the hole
    assert rows[9].frame == [[6.0, 60.0], [7.0, 70.0], [8.0, 80.0]] and rows[9].target == [9.0, 90.0] and rows[5].target is None
    order = [r.sample_order for r in rows.values()]
    again = {r.pos: r.sample_order for r in W.lag_frames(df.repartition(5), ["y", "z"], 3, ["k"], "ts", shuffle_seed=1).collect()}
    assert len(set(order)) == 6 and again == {p: r.sample_order for p, r in rows.items()}


def test_vector_autoregression(spark):
    rng = np.random.default_rng(3)
    y = np.zeros((400, 2))
    for t in range(2, 400):
        y[t] = [1, 2] + np.array([[.4, .2], [-.1, .5]]) @ y[t - 1] + [[.1, 0], [0, -.2]] @ y[t - 2] + rng.normal(size=2)
    big = y * [1e6, 1e-3] + [1e9, 7]
    rows = [("a", t, *map(float, big[t])) for t in range(400)] + [("b", t, 1.0 * t, 2.0) for t in range(4)]
    df = spark.createDataFrame(rows, "k string, ts int, u double, v double").withColumn(
        "ts", (F.lit(0) + F.col("ts")).cast("timestamp")).withColumn("v", F.when(F.col("v") != float(big[77, 1]), F.col("v")))
    models = M.fit_vector(df, ["u", "v"], ["k"], "ts", 2)
    got = {r.k: r for r in models.collect()}
    ok = [t for t in range(2, 400) if 77 not in (t, t - 1, t - 2)]
    x = np.array([[1, *big[t - 1], *big[t - 2]] for t in ok])
    mid, dev = x[:, 1:].mean(0), x[:, 1:].std(0)
    scaled = np.c_[np.ones(len(ok)), (x[:, 1:] - mid) / dev]
    want = np.linalg.lstsq(scaled, big[ok], rcond=None)[0]
    assert got["a"].n == len(ok) and got["b"].coef is None
    assert np.allclose(np.array(got["a"].coef), (want[1:] / dev[:, None]).T, rtol=1e-6)
    nxt = np.array(got["a"].const) + np.array(got["a"].coef) @ np.r_[big[399], big[398]]
    out = {(r.k, r.step): r for r in M.forecast_vector(df, models, ["u", "v"], ["k"], "ts", "1 second", 2, 3).collect()}
    assert len(out) == 6 and np.allclose([out["a", 1].u, out["a", 1].v], nxt) and out["b", 3].u is None
    second = np.array(got["a"].const) + np.array(got["a"].coef) @ np.r_[nxt, big[399]]
    assert np.allclose([out["a", 2].u, out["a", 2].v], second)
