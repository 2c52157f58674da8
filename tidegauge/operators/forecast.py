"""Autoregressive models fitted for many series at once.

Every estimator reduces to sums of outer products of lagged columns. Spark builds the lag rows and
adds the products up per series; what is left per series is one small matrix, solved inside a
vectorised function. No series is ever gathered in one place.
"""

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidegauge.operators.joins import null_safe_join
from tidegauge.operators.refit import sliding_forecasts
from tidegauge.operators.timeseries import ordered
from tidegauge.session import spool

MODEL = ("p int, q int, n bigint, aic double, sigma2 double, const double, "
         "phi array<double>, theta array<double>")

#: Widest (p, d, q) of models whose orders come with them; what an order search gives by default.
WIDEST = (6, 1, 6)

# Response surfaces of the unit-root statistic with constant, no trend
# (MacKinnon 1994 for p-values, MacKinnon 2010 for critical values).
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
SMALL_P = [2.1659, 1.4412, 0.038269]
LARGE_P = [1.7339, 0.93202, -0.12745, -0.010368]
CRITICAL = {
    "crit_1": [-3.43035, -6.5393, -16.786, -79.433],
    "crit_5": [-2.86154, -2.8903, -4.234, -40.040],
    "crit_10": [-2.56677, -1.5384, -2.809, 0.0],
}


# ---- sums of outer products ----------------------------------------------------------------

def gram(rows: DataFrame, keys: list[str], vec: str = "x") -> DataFrame:
    """``(keys..., n, g)``: row count and flattened sum of ``outer(vec, vec)`` per key.

    Arrow batches are reduced where they are read; only k*k numbers per key and batch move on. Columns
    that are zero for a key are left out of its product, so that the width other keys need does not
    change the order in which its numbers are added.
    """
    fields = [rows.schema[k] for k in keys]
    schema = T.StructType(fields + [T.StructField("n", T.LongType()),
                                    T.StructField("g", T.ArrayType(T.DoubleType()))])
    keys = list(keys)

    def product(np, part):
        used = np.flatnonzero(part.any(axis=0))
        own = np.ascontiguousarray(part[:, used])
        whole = np.zeros((part.shape[1], part.shape[1]))
        whole[np.ix_(used, used)] = own.T @ own
        return whole.ravel()

    def partial(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column(batch.schema.get_field_index(vec))
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes = batch.select(keys).to_pandas().groupby(
                keys, sort=False, dropna=False).ngroup().to_numpy()
            by = np.argsort(codes, kind="stable")
            codes, x = codes[by], x[by]
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            ends = np.r_[starts[1:], len(codes)]
            sums = [product(np, x[s:e]) for s, e in zip(starts, ends)]
            firsts = pa.array(by[starts])
            columns = [batch.column(batch.schema.get_field_index(k)).take(firsts) for k in keys]
            columns += [pa.array(ends - starts), pa.array(sums, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=keys + ["n", "g"])

    parts = rows.select(*keys, vec).mapInArrow(partial, schema)
    cells = parts.select(*keys, "n", F.posexplode("g").alias("_i", "_g"))
    added = cells.groupBy(*keys, "_i").agg(F.sum("_g").alias("_g"), F.sum("n").alias("_n"))
    return added.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        F.transform(F.sort_array(F.collect_list(F.struct("_i", "_g"))),
                    lambda c: c["_g"]).alias("g"))


def _least_squares(m, cols: list[int]):
    """Coefficients and residual sum of squares of the last column on ``cols``, from products."""
    import numpy as np
    size = np.sqrt(np.maximum(np.diag(m)[cols], 1e-300))
    xtx = m[np.ix_(cols, cols)] / np.outer(size, size)
    coef = np.linalg.lstsq(xtx, m[cols, -1] / size, rcond=None)[0] / size
    whole = np.r_[coef, -1.0]
    rows = [*cols, len(m) - 1]
    return coef, max(float(whole @ m[np.ix_(rows, rows)] @ whole), 0.0)


def _solve_grid(combos: list[tuple[int, int]], max_p: int, exact: bool = False):
    """Vectorised solver: least squares of every (p, q) sub-block of one product matrix.

    Column order: constant, y lags 1..max_p, residual lags 1..max_q, y; values less their mean,
    over their deviation, so that the system is as well conditioned on any level and in any unit.
    Coefficients come back in the units of the series. Orders above the caps of a series (or, if
    ``exact``, other than them) are left out.
    """
    def solve(g, mean, scale, p_cap, q_cap) -> pd.Series:
        import numpy as np
        out = []
        for flat, mu, s, p_top, q_top in zip(g, mean, scale, p_cap, q_cap):
            fits = []
            k = 0 if flat is None else int(round(math.sqrt(len(flat))))
            m = np.asarray(flat if k else [], dtype=float).reshape(k, k)
            rows = int(round(m[0, 0])) if k else 0  # the constant's square: rows that took part
            for p, q in combos if k else ():
                cols = [0] + list(range(1, 1 + p)) + list(range(1 + max_p, 1 + max_p + q))
                if p > p_top or q > q_top or rows <= len(cols) or exact and (p, q) != (p_top, q_top):
                    continue
                coef, rss = _least_squares(m, cols)
                sigma2 = rss / rows * s * s
                aic = rows * math.log(max(sigma2, 1e-300)) + 2 * (len(cols) + 1)
                phi = [float(v) for v in coef[1:1 + p]]
                fits.append((p, q, int(rows), aic, sigma2, float(coef[0]) * s + mu * (1 - sum(phi)),
                             phi, [float(v) for v in coef[1 + p:]]))
            out.append(fits)
        return pd.Series(out)

    names = ["p", "q", "n", "aic", "sigma2", "const", "phi", "theta"]

    def as_dicts(g: pd.Series, mean: pd.Series, scale: pd.Series, p_cap: pd.Series,
                 q_cap: pd.Series) -> pd.Series:
        return solve(g, mean, scale, p_cap, q_cap).map(lambda fits: [dict(zip(names, f)) for f in fits])
    return F.pandas_udf(as_dicts, f"array<struct<{_struct(MODEL)}>>")


#: Per series, beside its keys: mean and deviation of the values, highest orders it can be fitted with.
FRAME = ["_mean", "_scale", "_p", "_q"]


def _vector(usable: Column, size: int, *parts: Column) -> Column:
    """Row of a product matrix, constant first; zeros, which add nothing, where it is not usable. So
    a series without a usable row keeps its place without a second look at the data."""
    x = F.concat(F.array(F.lit(1.0)), *parts)
    return F.when(usable, x).otherwise(F.array_repeat(F.lit(0.0), size)).alias("x")


def _struct(ddl: str) -> str:
    return ", ".join(f"{part.split()[0]}:{part.split(' ', 1)[1]}" for part in ddl.split(", "))


# ---- lag rows ------------------------------------------------------------------------------

def with_lags(df: DataFrame, value: str, n: int, keys: list[str], ts: str, out: str) -> DataFrame:
    """Array of the values 1 to ``n`` rows back, newest first: by position, null where there is none."""
    if n == 0:
        return df.withColumn(out, F.expr("cast(array() as array<double>)"))
    w = ordered(keys, ts)
    return df.withColumn(out, F.array(*(F.lag(F.col(value).cast("double"), k).over(w) for k in range(1, n + 1))))


def complete(lags: str, n) -> Column:
    """Whether the first ``n`` lags are all there."""
    return F.forall(F.slice(lags, 1, n), lambda v: v.isNotNull())


def _scaled(lags: str, shift, n) -> Column:
    """The first ``n`` lags less ``shift``, over the deviation of the series; 0 in place of the rest."""
    return F.transform(lags, lambda v, i: F.when(i < n, (v - shift) / F.col("_scale")).otherwise(0.0))


def _framed(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``_mean`` and ``_scale`` of ``value``, and ``_len``, its number of values, per series."""
    whole = Window.partitionBy(*keys)
    spread = F.stddev_pop(value).over(whole)
    return (df.withColumn("_mean", F.coalesce(F.avg(value).over(whole), F.lit(0.0)))
            .withColumn("_scale", F.when(spread > 0, spread).otherwise(1.0))
            .withColumn("_len", F.count(value).over(whole)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def differenced(series: DataFrame, value: str, d: int | Column, keys: list[str], ts: str, most: int | None = None,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """``_w``: the d-times differenced value, null beside a hole; rows, ``_level`` and ``keep`` stay.

    ``d`` may be a column that differs between series, up to ``most``. ``_ends`` holds the last value of
    each differencing level, needed to undo the differences.
    """
    df = series.select(*keys, ts, *keep, F.col(value).cast("double").alias("_level")).withColumn(
        "_w", F.col("_level"))
    names = [f"_d{i + 1}" for i in range(d if most is None else most)]
    for i, name in enumerate(names):
        change = F.col("_w") - F.lag("_w").over(ordered(keys, ts))
        df = df.withColumn(name, F.col("_w")).withColumn(
            "_w", change if most is None else F.when(d > i, change).otherwise(F.col("_w")))
    empty = F.expr("cast(array() as array<double>)")
    return (df.withColumn("_ends", F.array(*names) if names else empty)
            .select(*keys, ts, *keep, "_level", "_w", "_ends"))


def _attached(series: DataFrame, models: DataFrame, value: str, keys: list[str], ts: str) -> DataFrame:
    """Rows of a series with the model of their own, ``_model``; null where there is none."""
    own = models.select(*keys, F.struct("p", "d", "q", "const", "phi", "theta").alias("_model"))
    return null_safe_join(series.select(*keys, ts, value), own, list(keys), "left")


def _with_innovations(df: DataFrame, keys: list[str], ts: str, q: int,
                      long_order: int) -> DataFrame:
    """``_e``: residuals of a long autoregression, the stand-in for unobserved innovations."""
    if q == 0:
        return df.withColumn("_e", F.lit(0.0))
    # a short series takes a shorter autoregression
    order = F.least(F.lit(long_order), F.greatest(F.lit(1), F.floor((F.col("_len") - 4) / 4))).cast("int")
    lagged = _framed(with_lags(df, "_w", long_order, keys, ts, "_far"), "_w", keys).withColumns(
        {"_p": order, "_q": F.lit(0)})
    usable = complete("_far", F.col("_p")) & F.col("_w").isNotNull()
    x = _vector(usable, long_order + 2, _scaled("_far", F.col("_mean"), F.col("_p")),
                F.array((F.col("_w") - F.col("_mean")) / F.col("_scale")))
    solver = _solve_grid([(k, 0) for k in range(1, long_order + 1)], long_order, exact=True)
    fits = gram(lagged.select(*keys, *FRAME, x), [*keys, *FRAME])
    coef = fits.select(*keys, F.get(solver("g", *FRAME), F.lit(0)).alias("_m"))
    joined = null_safe_join(lagged, coef, list(keys))
    far = F.slice("_far", 1, F.size("_m.phi"))
    left = F.col("_w") - F.col("_m.const") - dot(F.col("_m.phi"), far)
    return joined.withColumn("_e", F.when(usable & F.col("_m").isNotNull(), left)).drop("_m", "_far", "_len", *FRAME)


def _lagged(series: DataFrame, value: str, keys: list[str], ts: str, p: int, d: int | Column, q: int,
            long_order: int | None, **more) -> DataFrame:
    far = long_order or p + q + 4
    df = _with_innovations(differenced(series, value, d, keys, ts, **more), keys, ts, q, far)
    return with_lags(with_lags(df, "_w", p, keys, ts, "_yl"), "_e", q, keys, ts, "_el")


def arma_rows(series: DataFrame, value: str, keys: list[str], ts: str, p: int, d: int, q: int,
              long_order: int | None = None) -> DataFrame:
    """Rows with all the lags an ARIMA(p, d, q) needs: ``_w, _level, _ends, _e, _yl, _el``."""
    df = _lagged(series, value, keys, ts, p, d, q, long_order)
    return df.where(F.col("_w").isNotNull() & complete("_yl", p) & complete("_el", q))


# ---- fitting -------------------------------------------------------------------------------

def fit_grid(series: DataFrame, value: str, keys: list[str], ts: str, d: int,
             combos: list[tuple[int, int]], long_order: int | None = None,
             adapt: bool = False) -> DataFrame:
    """One model row per series and (p, q), all from one product matrix per series.

    All orders share the same rows, so their AIC values can be compared. With ``adapt`` a short
    series is asked for fewer lags, by its own length alone, and fitted with the orders that leaves.
    A series that nothing can be fitted to has one row, of nulls. Lags never reach across a hole.
    """
    max_p, max_q = max(p for p, _ in combos), max(q for _, q in combos)
    rows = _framed(_lagged(series, value, keys, ts, max_p, d, max_q, long_order), "_w", keys)
    room = F.greatest(F.lit(0), F.floor((F.col("_len") - 4) / 6)).cast("int")
    rows = rows.withColumns({"_p": F.least(F.lit(max_p), room) if adapt else F.lit(max_p),
                             "_q": F.least(F.lit(max_q), room) if adapt else F.lit(max_q)})
    usable = F.col("_w").isNotNull() & complete("_yl", F.col("_p")) & complete("_el", F.col("_q"))
    x = _vector(usable, max_p + max_q + 2, _scaled("_yl", F.col("_mean"), F.col("_p")),
                _scaled("_el", F.lit(0.0), F.col("_q")), F.array((F.col("_w") - F.col("_mean")) / F.col("_scale")))
    fits = gram(rows.select(*keys, *FRAME, x), [*keys, *FRAME])
    return fits.select(*keys, F.inline_outer(_solve_grid(combos, max_p)("g", *FRAME))).withColumn("d", F.lit(d))


def fit_arima(series: DataFrame, value: str, keys: list[str], ts: str,
              order: tuple[int, int, int], long_order: int | None = None) -> DataFrame:
    """Conditional least squares for AR, Hannan-Rissanen two-stage least squares with MA terms."""
    p, d, q = order
    return fit_grid(series, value, keys, ts, d, [(p, q)], long_order)


def build_model(series: DataFrame, value: str, keys: list[str], ts: str, max_p: int = 6,
                max_q: int = 6, d: int | None = None, stored: DataFrame | None = None,
                rebuild: bool = True) -> DataFrame:
    """Order search by AIC over p <= max_p, q <= max_q; the stored model when not rebuilding.

    Without ``d`` a series is differenced once when the unit-root test does not reject. Every series
    has a row, which depends on that series alone; short ones are searched over fewer orders.
    """
    if not rebuild:
        if stored is None:
            raise ValueError("no stored model to reuse")
        return stored
    combos = [(p, q) for p in range(max_p + 1) for q in range(max_q + 1)]

    def best(models: DataFrame, by: list[str]) -> DataFrame:
        rank = F.struct("aic", F.col("p") + F.col("q"), "p")
        row = F.struct(*[c for c in models.columns if c not in by])
        return models.groupBy(*by).agg(F.min_by(row, rank).alias("_m")).select(*by, "_m.*")

    if d is not None:
        return best(fit_grid(series, value, keys, ts, d, combos, adapt=True), keys)
    # the flag follows from the keys, so it can ride along as one of them: one fit, no second join
    by = keys + ["stationary"]
    tested = adf(series, value, keys, ts).select(*keys, F.coalesce("stationary", F.lit(True)).alias("stationary"))
    flagged = null_safe_join(series.select(*keys, ts, F.col(value).cast("double").alias("_y")), tested, list(keys))
    change = F.col("_y") - F.lag("_y").over(ordered(by, ts))
    chosen = flagged.withColumn("_x", F.when(F.col("stationary"), F.col("_y")).otherwise(change))
    # written once: the fit reads its series twice and must not repeat the test each time
    ready = spool(chosen.select(*by, ts, "_x"))
    models = best(fit_grid(ready, "_x", by, ts, 0, combos, adapt=True), by)
    return models.withColumn("d", F.when(F.col("stationary"), 0).otherwise(1)).drop("stationary")


def fitted_values(series: DataFrame, models: DataFrame, value: str, keys: list[str], ts: str,
                  order: tuple[int, int, int] | None = None, long_order: int | None = None,
                  widest: tuple[int, int, int] = WIDEST) -> DataFrame:
    """One-step in-sample predictions in the units of the series: ``keys, ts, actual, fitted``.

    Without ``order`` every series follows its own model's (p, d, q), up to ``widest``: the widest that
    was searched, whose long autoregression gives the innovations here as it did there. There a series
    without a model has no rows.
    """
    p, d, q = order or widest
    if order:
        rows = arma_rows(series, value, keys, ts, p, d, q, long_order).join(
            models.select(*keys, "const", "phi", "theta"), keys)
    else:
        own = _lagged(_attached(series, models, value, keys, ts), value, keys, ts, p, F.col("_model.d"), q, long_order,
                      most=d, keep=("_model",))
        rows = own.where(F.col("_w").isNotNull() & complete("_yl", F.col("_model.p")) & complete("_el", F.col("_model.q"))
                         ).select("*", "_model.const", "_model.phi", "_model.theta")
    step = (F.col("const") + dot("phi", F.slice("_yl", 1, F.size("phi")))
            + dot("theta", F.slice("_el", 1, F.size("theta"))))
    return rows.select(*keys, ts, F.col("_level").alias("actual"),
                       (F.col("_level") - (F.col("_w") - step)).alias("fitted"))


def model_metrics(fitted: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """AIC of the model and mean absolute error of its fitted values."""
    mae = fitted.groupBy(*keys).agg(F.avg(F.abs(F.col("actual") - F.col("fitted"))).alias("mae"))
    return models.select(*keys, "aic").join(mae, keys)


# ---- forecasting ---------------------------------------------------------------------------

def forecast(series: DataFrame, models: DataFrame, value: str, keys: list[str], ts: str, freq: str,
             order: tuple[int, int, int] | None, steps: int, long_order: int | None = None,
             widest: tuple[int, int, int] = WIDEST) -> DataFrame:
    """``steps`` values ahead of each series, every prediction fed back as the newest lag.

    The recursion runs on one short lag array per series. ``(keys..., step, ts, forecast)``; the
    forecast is null where the series has no model or its newest lags have a hole. With ``order`` None
    every series follows its own model's (p, d, q), as in :func:`fitted_values`.
    """
    p, d, q = order or widest
    if order:
        levels = differenced(series, value, d, keys, ts)
        own = models.select(*keys, "const", "phi", "theta", F.lit(d).alias("_times"))
    else:
        levels = differenced(_attached(series, models, value, keys, ts), value, F.col("_model.d"), keys, ts, most=d,
                             keep=("_model",))
        own = models.select(*keys, "const", "phi", "theta", F.col("d").alias("_times"))
    rows = _with_innovations(levels, keys, ts, q, long_order or p + q + 4)

    def newest(column: str, n: int) -> Column:
        if n == 0:
            return F.expr("cast(array() as array<double>)")
        return F.array(*(F.lag(column, k).over(ordered(keys, ts)) if k else F.col(column) for k in range(n)))

    state = rows.select(*keys, ts, "_w", "_ends", newest("_w", p).alias("_yl"), newest("_e", q).alias("_el"))
    # of a series that ends in a hole the last value counts
    last = state.groupBy(*keys).agg(F.max_by(F.struct(ts, "_ends", "_yl", "_el"), F.when(
        F.col("_w").isNotNull(), F.col(ts))).alias("_s"))
    ready = null_safe_join(last.select(*keys, "_s.*"), own, list(keys))

    def newer(lags: Column, new: Column, weights: str) -> Column:
        return F.slice(F.concat(F.array(new), lags), 1, F.size(weights))

    def step(s: Column, _) -> Column:
        nxt = F.col("const") + dot(F.col("phi"), s["yl"]) + dot(F.col("theta"), s["el"])
        return F.struct(newer(s["yl"], nxt, "phi").alias("yl"), newer(s["el"], F.lit(0.0), "theta").alias("el"),
                        F.concat(s["out"], F.array(nxt)).alias("out"))

    # a model reads as many lags as it has weights, whatever the others need
    start = F.struct(F.slice("_yl", 1, F.size("phi")).alias("yl"), F.slice("_el", 1, F.size("theta")).alias("el"),
                     F.expr("cast(array() as array<double>)").alias("out"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["out"])
    out = ready.select(*keys, ts, "_ends", "_times", F.posexplode(path).alias("_k", "forecast"))
    for level in range(d, 0, -1):
        upto = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("forecast", F.when(F.col("_times") < level, F.col("forecast")).otherwise(
            F.element_at("_ends", level) + F.sum("forecast").over(upto)))
    return out.select(*keys, (F.col("_k") + 1).alias("step"),
                      (F.col(ts) + (F.col("_k") + 1) * F.expr(f"INTERVAL {freq}")).alias(ts),
                      "forecast")


def generate_forecasts(series: DataFrame, value: str, keys: list[str], ts: str, freq: str,
                       order: tuple[int, int, int] | DataFrame, window: int, total: int,
                       train_share: float | None = None,
                       prior: DataFrame | None = None) -> DataFrame:
    """Sliding refits: each window is fitted on its own rows and forecasts max(p, q, 1) steps.

    ``order`` is one (p, d, q) for all series or the models of an order search, of which each series
    takes its own. Earlier forecasts, if given, come first.
    """
    new = sliding_forecasts(series, value, keys, ts, freq, order, window, total, train_share)
    return new if prior is None else prior.unionByName(new, allowMissingColumns=True)


# ---- vector autoregression -----------------------------------------------------------------

VECTOR_MODEL = "n bigint, const array<double>, coef array<array<double>>"


def fit_vector(series: DataFrame, values: list[str], keys: list[str], ts: str, p: int) -> DataFrame:
    """Vector autoregression: every column of ``values`` on the last ``p`` rows of all of them.

    ``(keys..., n, const, coef)``: one row of ``coef`` per column, holding the weights of all columns
    one row back, then two, and so on. Lags go by position and never across a hole; a series with too
    few rows has nulls. One product matrix per series serves all columns.
    """
    k = len(values)
    whole = Window.partitionBy(*keys)
    df = series.select(*keys, ts, *(F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)))
    frame = {}
    for i in range(k):
        spread = F.stddev_pop(f"_v{i}").over(whole)
        frame[f"_m{i}"] = F.coalesce(F.avg(f"_v{i}").over(whole), F.lit(0.0))
        frame[f"_s{i}"] = F.when(spread > 0, spread).otherwise(1.0)
    df = df.withColumns(frame).withColumns(
        {f"_z{i}": (F.col(f"_v{i}") - F.col(f"_m{i}")) / F.col(f"_s{i}") for i in range(k)})
    now = [f"_z{i}" for i in range(k)]
    cells = F.array(*(F.lag(z, back).over(ordered(keys, ts)) for back in range(1, p + 1) for z in now), *now)
    df = df.withColumn("_x", cells)
    x = _vector(F.forall("_x", lambda v: v.isNotNull()), 1 + k * (p + 1), F.col("_x"))
    fits = gram(df.select(*keys, *frame, x), [*keys, *frame])

    def solve(g: pd.Series, mean: pd.Series, scale: pd.Series) -> pd.DataFrame:
        import numpy as np
        out, n_cols = [], 1 + k * p
        for flat, mu, s in zip(g, mean, scale):
            m = np.asarray(flat, dtype=float).reshape(n_cols + k, -1)
            rows = int(round(m[0, 0]))
            if rows <= n_cols:
                out.append((rows, None, None))
                continue
            size = np.sqrt(np.maximum(np.diag(m)[:n_cols], 1e-300))
            found = np.linalg.lstsq(m[:n_cols, :n_cols] / np.outer(size, size), m[:n_cols, n_cols:] / size[:, None],
                                    rcond=None)[0] / size[:, None]
            coef = found[1:].T * np.asarray(s)[:, None] / np.tile(s, p)
            const = found[0] * s + mu - coef @ np.tile(mu, p)
            out.append((rows, const.tolist(), coef.tolist()))
        return pd.DataFrame(out, columns=["n", "const", "coef"])

    each = [F.array(*(f"_{c}{i}" for i in range(k))) for c in "ms"]
    return fits.select(*keys, F.pandas_udf(solve, VECTOR_MODEL)("g", *each).alias("_m")).select(*keys, "_m.*")


def forecast_vector(series: DataFrame, models: DataFrame, values: list[str], keys: list[str], ts: str, freq: str,
                    p: int, steps: int) -> DataFrame:
    """``steps`` rows ahead of each series, all columns fed back together: ``keys, step, ts, values``.

    The columns are null where the series has no model or its newest ``p`` rows have a hole; of a
    series that ends in rows with a hole the last whole row counts.
    """
    k, w = len(values), ordered(keys, ts)
    cols = [F.col(v).cast("double") for v in values]
    newest = F.array(*(F.lag(c, back).over(w) if back else c for back in range(p) for c in cols))
    there = F.forall(F.array(*cols), lambda v: v.isNotNull())
    state = series.select(*keys, ts, newest.alias("_lags"), there.alias("_there"))
    last = state.groupBy(*keys).agg(F.max_by(F.struct(ts, "_lags"), F.when(F.col("_there"), F.col(ts))).alias("_s"))
    ready = null_safe_join(last.select(*keys, "_s.*"), models.select(*keys, "const", "coef"), list(keys))

    def step(s: Column, _) -> Column:
        nxt = F.zip_with("const", "coef", lambda c, weights: c + dot(weights, s["lags"]))
        return F.struct(F.slice(F.concat(nxt, s["lags"]), 1, k * p).alias("lags"),
                        F.concat(s["out"], F.array(nxt)).alias("out"))

    start = F.struct(F.col("_lags").alias("lags"), F.expr("cast(array() as array<array<double>>)").alias("out"))
    path = F.when(F.col("const").isNotNull(), F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["out"])).otherwise(
        F.array_repeat(F.lit(None).cast("array<double>"), steps))
    return ready.select(*keys, ts, F.posexplode(path).alias("_k", "_y")).select(
        *keys, (F.col("_k") + 1).alias("step"),
        (F.col(ts) + (F.col("_k") + 1) * F.expr(f"INTERVAL {freq}")).alias(ts),
        *(F.col("_y")[i].alias(v) for i, v in enumerate(values)))


# ---- unit root -----------------------------------------------------------------------------

def adf(series: DataFrame, value: str, keys: list[str], ts: str,
        max_lag: int | None = None, search: bool = True) -> DataFrame:
    """Augmented Dickey-Fuller test with constant; lag order by AIC, or without ``search`` the highest.

    ``statistic, p_value, used_lag, n_obs, crit_1, crit_5, crit_10, stationary`` per series; a
    series that cannot be tested (too short, constant) has nulls.
    """
    base = series.select(*keys, ts, F.col(value).cast("double").alias("_y")).withColumn(
        "_prev", F.lag("_y").over(ordered(keys, ts))).withColumn("_dy", F.col("_y") - F.col("_prev"))
    limit = F.greatest(F.lit(0), F.least(F.ceil(12.0 * F.pow(F.col("_len") / 100.0, F.lit(0.25))),
                                         F.floor(F.col("_len") / 2) - 2))
    limit = (limit if max_lag is None else F.least(limit, F.lit(max_lag))).cast("int")
    base = _framed(base, "_y", keys).withColumn("_limit", limit)
    # how wide the array of lags must be; which of them a series uses depends on that series alone
    width = max_lag if max_lag is not None else base.agg(F.max("_limit")).first()[0] or 0
    rows = with_lags(base, "_dy", width, keys, ts, "_lags")

    def design(df: DataFrame, lags: str) -> DataFrame:
        usable = F.col("_dy").isNotNull() & complete("_lags", F.col(lags))
        x = _vector(usable, width + 3, F.array((F.col("_prev") - F.col("_mean")) / F.col("_scale")),
                    _scaled("_lags", F.lit(0.0), F.col(lags)), F.array(F.col("_dy") / F.col("_scale")))
        return df.select(*keys, lags, x)

    grams = gram(design(rows, "_limit"), [*keys, "_limit"])

    def choose(g: pd.Series, limit: pd.Series) -> pd.Series:
        import numpy as np
        out = []
        for flat, top in zip(g, limit):
            k = int(round(math.sqrt(len(flat))))
            m = np.asarray(flat, dtype=float).reshape(k, k)
            rows_, best = m[0, 0], (math.inf, 0)
            for lag in () if rows_ == 0 else range(0 if search else int(top), int(top) + 1):
                _, rss = _least_squares(m, list(range(2 + lag)))
                best = min(best, (rows_ * math.log(max(rss, 1e-300) / rows_) + 2 * (2 + lag), lag))
            out.append(best[1])
        return pd.Series(out)

    lag_of = grams.select(*keys, F.pandas_udf(choose, "int")("g", "_limit").alias("used_lag"))
    final = gram(design(null_safe_join(rows, lag_of, list(keys)), "used_lag"), [*keys, "used_lag"])

    stat_names = ["statistic", "p_value", "used_lag", "n_obs", *CRITICAL]
    fixed = (TAU_STAR, TAU_MIN, TAU_MAX, list(SMALL_P), list(LARGE_P), dict(CRITICAL))

    def test(g: pd.Series, lag: pd.Series) -> pd.DataFrame:
        import numpy as np
        star, low, high, small, large, critical = fixed
        out = []
        for flat, lag_ in zip(g, lag):
            k = int(round(math.sqrt(len(flat))))
            m = np.asarray(flat, dtype=float).reshape(k, k)
            rows_ = int(round(m[0, 0]))
            cols = list(range(2 + int(lag_)))
            xtx = m[np.ix_(cols, cols)]
            tau = math.nan
            if rows_ > len(cols) and np.linalg.matrix_rank(xtx) == len(cols):
                coef, rss = _least_squares(m, cols)
                var = rss / (rows_ - len(cols)) * np.linalg.inv(xtx)[1, 1]
                tau = float(coef[1] / math.sqrt(var)) if var > 0 else math.nan
            if math.isnan(tau):
                prob = math.nan
            elif tau > high:
                prob = 1.0
            elif tau < low:
                prob = 0.0
            else:
                poly = small if tau <= star else large
                z = sum(c * tau ** i for i, c in enumerate(poly))
                prob = 0.5 * math.erfc(-z / math.sqrt(2.0))
            out.append([tau, prob, int(lag_), int(rows_)] + [
                sum(c / rows_ ** i for i, c in enumerate(cs)) if rows_ else math.nan for cs in critical.values()])
        return pd.DataFrame(out, columns=stat_names)

    ddl = "statistic double, p_value double, used_lag int, n_obs bigint, " + ", ".join(
        f"{c} double" for c in CRITICAL)
    tested = final.select(*keys, F.pandas_udf(test, ddl)("g", "used_lag").alias("_t"))
    return tested.select(*keys, "_t.*").withColumn("stationary", check_stationarity())


def check_stationarity(p_value: str = "p_value") -> Column:
    return F.col(p_value) < 0.05
