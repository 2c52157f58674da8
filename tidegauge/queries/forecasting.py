"""STA: unit-root test, autoregressive fits, order search, sliding refits and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import forecast as M, likelihood, stats as S
from tidegauge.plans import anomaly
from tidegauge.operators.timeseries import log_difference, resample_counts
from tidegauge.queries import query
from tidegauge.queries.common import SQL_MONTHLY, SQL_Z, monthly_orders, z_series
from tidegauge.queries.statistics import SQL_FLAGS
from tidegauge.session import spool
from tidegauge.sources.tables import table

KEY = ["sentiment"]
TS = "ts_bin"
FREQ = "10 minutes"
AR1 = (1, 0, 0)
ARMA = (2, 0, 1)

SQL_TYPES = """b AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts_bin, count(*) AS cnt
  FROM events GROUP BY 1, 2),
spine AS (SELECT event_type, unnest(generate_series(min(ts_bin), max(ts_bin), INTERVAL 1 HOUR)) AS ts_bin
  FROM b GROUP BY 1),
zs AS (SELECT s.event_type, s.ts_bin, coalesce(cnt, 0)::DOUBLE AS y FROM spine s
  LEFT JOIN b ON b.event_type = s.event_type AND b.ts_bin = s.ts_bin)"""
SQL_TYPES_HOURLY = SQL_TYPES + ", s AS (SELECT event_type AS k, ts_bin AS ts, y FROM zs)"
SQL_USERS = SQL_TYPES.replace("event_type", "user_id")


def hourly(spark, folder, key):
    return resample_counts(table(spark, folder, "events").select("ts", key), "ts", "1 hour", [key])


def hourly_types(spark, folder):
    return hourly(spark, folder, "event_type")


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("sta05_adf_test")
def adf(spark, folder):
    out = M.adf(z_series(spark, folder), "z", KEY, TS)
    return rounded(out, "statistic", "p_value", "crit_1", "crit_5", "crit_10")


@query("sta05_df_test_without_lags", f"""WITH {SQL_Z},
d AS (SELECT sentiment, z - lag(z) OVER w AS dy, lag(z) OVER w AS x FROM zs
  WINDOW w AS (PARTITION BY sentiment ORDER BY ts_bin)),
r AS (SELECT sentiment, regr_slope(dy, x) AS b, regr_syy(dy, x) AS syy, regr_sxx(dy, x) AS sxx,
  regr_sxy(dy, x) AS sxy, count(dy) AS n FROM d WHERE dy IS NOT NULL GROUP BY 1)
SELECT sentiment, n AS n_obs, round(b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 4) AS statistic
FROM r""")
def df_test(spark, folder):
    out = M.adf(z_series(spark, folder), "z", KEY, TS, max_lag=0)
    return rounded(out.select("sentiment", "n_obs", "statistic"), "statistic", digits=4)


SQL_LEVELS = SQL_MONTHLY + """,
l2 AS (SELECT * FROM (SELECT priority, ts, y, lag(y, 1) OVER w AS a, lag(y, 2) OVER w AS b
  FROM monthly WINDOW w AS (PARTITION BY priority ORDER BY ts)) WHERE a IS NOT NULL)"""


@query("sta05_adf_levels_one_lag", f"""WITH {SQL_LEVELS},
d AS (SELECT priority, y - a AS y, a, a - b AS b FROM l2 WHERE b IS NOT NULL),
k AS (SELECT priority, count(*) AS n, var_pop(y) AS vy, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
  covar_pop(a, y) AS cay, covar_pop(b, y) AS cby FROM d GROUP BY 1),
c AS (SELECT *, (bb * cay - ab * cby) / (aa * bb - ab * ab) AS b1, (aa * cby - ab * cay) / (aa * bb - ab * ab) AS b2 FROM k),
z AS (SELECT priority, n, b1 / sqrt((vy - b1 * cay - b2 * cby) / (n - 3) * bb / (aa * bb - ab * ab)) AS with_lag FROM c)
SELECT priority, n AS n_obs, round(with_lag, 4) AS statistic FROM z""")
def adf_levels(spark, folder):
    """On totals of 1e7 and more, in their own units; all series take the one lag by force."""
    return M.adf(monthly_orders(spark, folder), "y", ["priority"], "ts", max_lag=1, search=False).select(
        "priority", "n_obs", F.round("statistic", 4).alias("statistic"))


@query("sta05_adf_every_user", f"""WITH {SQL_USERS},
d AS (SELECT user_id, y - lag(y) OVER w AS dy, lag(y) OVER w AS x FROM zs WINDOW w AS (PARTITION BY user_id ORDER BY ts_bin)),
r AS (SELECT user_id, regr_slope(dy, x) AS b, regr_syy(dy, x) AS syy, regr_sxx(dy, x) AS sxx,
  regr_sxy(dy, x) AS sxy, count(dy) AS n FROM d GROUP BY 1)
SELECT user_id, n AS n_obs, CASE WHEN n >= 20 THEN round(b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 4) END
  AS statistic FROM r""")
def adf_users(spark, folder):
    """Thousands of series at once, without lags, where the statistic has a closed form; of series
    with fewer than 20 changes only their number is compared (they may be exact lines)."""
    tested = M.adf(hourly(spark, folder, "user_id"), "cnt", ["user_id"], TS, max_lag=0)
    return tested.select("user_id", "n_obs", F.when(F.col("n_obs") >= 20, F.round("statistic", 4)).alias("statistic"))


@query("sta10_fit_ar1_levels", f"""WITH {SQL_LEVELS}
SELECT priority, count(*) AS n, round(regr_slope(y, a), 5) AS phi, round(regr_intercept(y, a) / 1e6, 4) AS const_millions
FROM l2 GROUP BY 1""")
def fit_ar1_levels(spark, folder):
    m = M.fit_arima(monthly_orders(spark, folder), "y", ["priority"], "ts", AR1)
    return m.select("priority", "n", F.round(F.element_at("phi", 1), 5).alias("phi"),
                    F.round(F.col("const") / 1e6, 4).alias("const_millions"))


@query("sta06_stationarity")
def stationarity(spark, folder):
    logged = log_difference(monthly_orders(spark, folder), "y", ["priority"], "ts")
    raw = M.adf(logged, "y", ["priority"], "ts").withColumn("series", F.lit("raw"))
    diff = M.adf(logged.where("log_diff IS NOT NULL"), "log_diff", ["priority"], "ts").withColumn(
        "series", F.lit("log_diff"))
    return raw.unionByName(diff).select("priority", "series", F.round("p_value", 6).alias("p_value"),
                                        "stationary")


@query("sta08_pacf_two_lags", f"""WITH {SQL_Z},
c AS (SELECT sentiment, z - avg(z) OVER (PARTITION BY sentiment) AS c, ts_bin FROM zs),
l AS (SELECT sentiment, c, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2 FROM c
  WINDOW w AS (PARTITION BY sentiment ORDER BY ts_bin)),
r AS (SELECT sentiment, sum(c * c1) / sum(c * c) AS r1, sum(c * c2) / sum(c * c) AS r2 FROM l GROUP BY 1)
SELECT sentiment, 0 AS lag, 1.0::DOUBLE AS pacf FROM r UNION ALL SELECT sentiment, 1, round(r1, 6) FROM r
UNION ALL SELECT sentiment, 2, round((r2 - r1 * r1) / (1 - r1 * r1), 6) FROM r""")
def pacf_two(spark, folder):
    return rounded(S.pacf(z_series(spark, folder), "z", KEY, TS, 2), "pacf")


SQL_AR1 = SQL_Z + """,
lz AS (SELECT sentiment, ts_bin, z, lag(z) OVER (PARTITION BY sentiment ORDER BY ts_bin) AS x FROM zs),
ar AS (SELECT sentiment, count(x) AS n, regr_slope(z, x) AS b, regr_intercept(z, x) AS a,
  regr_syy(z, x) - regr_sxy(z, x) * regr_sxy(z, x) / regr_sxx(z, x) AS rss
  FROM lz WHERE x IS NOT NULL GROUP BY 1)"""


@query("sta10_fit_ar1", f"""WITH {SQL_AR1}
SELECT sentiment, n, round(a, 6) AS const, round(b, 6) AS phi, round(rss / n, 6) AS sigma2 FROM ar""")
def fit_ar1(spark, folder):
    m = M.fit_arima(z_series(spark, folder), "z", KEY, TS, AR1)
    return rounded(m.select("sentiment", "n", "const", F.element_at("phi", 1).alias("phi"), "sigma2"),
                   "const", "phi", "sigma2")


@query("sta10_fit_ar_log_diff", """WITH m AS (SELECT o_orderpriority AS priority,
  date_trunc('month', o_orderdate)::TIMESTAMP AS ts, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2),
l AS (SELECT priority, ts, ln(y) - lag(ln(y)) OVER (PARTITION BY priority ORDER BY ts) AS d FROM m),
x AS (SELECT priority, d, lag(d) OVER (PARTITION BY priority ORDER BY ts) AS x FROM l WHERE d IS NOT NULL)
SELECT priority, round(regr_intercept(d, x), 6) AS const, round(regr_slope(d, x), 6) AS phi FROM x
WHERE x IS NOT NULL GROUP BY 1""")
def fit_ar_log(spark, folder):
    logged = log_difference(monthly_orders(spark, folder), "y", ["priority"], "ts").where(
        "log_diff IS NOT NULL")
    m = M.fit_arima(logged, "log_diff", ["priority"], "ts", AR1)
    return rounded(m.select("priority", "const", F.element_at("phi", 1).alias("phi")), "const", "phi")


def _two_regressors(source, group, y="y", a="a", b="b"):
    """Least squares of y on a and b with constant, written out in co-moments."""
    return f"""SELECT {group}, n, my - b1 * ma - b2 * mb AS c, b1, b2, n * (vy - b1 * cay - b2 * cby) AS rss FROM (
  SELECT *, (bb * cay - ab * cby) / (aa * bb - ab * ab) AS b1,
    (aa * cby - ab * cay) / (aa * bb - ab * ab) AS b2 FROM (
    SELECT {group}, count(*) AS n, avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb, var_pop({y}) AS vy,
      var_pop({a}) AS aa, var_pop({b}) AS bb, covar_pop({a}, {b}) AS ab, covar_pop({a}, {y}) AS cay,
      covar_pop({b}, {y}) AS cby FROM {source} GROUP BY {group}))"""


SQL_LAGS = SQL_Z + """,
l2 AS (SELECT * FROM (SELECT sentiment, ts_bin, z AS y, lag(z, 1) OVER w AS a, lag(z, 2) OVER w AS b
  FROM zs WINDOW w AS (PARTITION BY sentiment ORDER BY ts_bin)) WHERE b IS NOT NULL)"""


@query("sta10_fit_ar2", f"""WITH {SQL_LAGS}, m AS ({_two_regressors("l2", "sentiment")})
SELECT sentiment, n, round(c, 6) AS const, round(b1, 6) AS phi_1, round(b2, 6) AS phi_2,
  round(n * ln(rss / n) + 8, 4) AS aic FROM m""")
def fit_ar2(spark, folder):
    m = M.fit_arima(z_series(spark, folder), "z", KEY, TS, (2, 0, 0))
    return m.select("sentiment", "n", F.round("const", 6).alias("const"),
                    F.round(F.element_at("phi", 1), 6).alias("phi_1"),
                    F.round(F.element_at("phi", 2), 6).alias("phi_2"), F.round("aic", 4).alias("aic"))


SQL_INNOVATIONS = """x AS (SELECT * FROM (SELECT k, ts, y, lag(y) OVER (PARTITION BY k ORDER BY ts) AS x FROM s)
  WHERE x IS NOT NULL AND y IS NOT NULL),
far AS (SELECT k, regr_intercept(y, x) AS c, regr_slope(y, x) AS f FROM x GROUP BY 1),
e AS (SELECT x.k, ts, y, y - c - f * x AS e FROM x JOIN far ON far.k = x.k),
r AS (SELECT * FROM (SELECT k, ts, y, lag(y) OVER w AS a, lag(e) OVER w AS b FROM e
  WINDOW w AS (PARTITION BY k ORDER BY ts)) WHERE b IS NOT NULL)"""


@query("sta10_fit_ar2_levels", f"""WITH {SQL_LEVELS}, q AS (SELECT * FROM l2 WHERE b IS NOT NULL),
m AS ({_two_regressors("q", "priority")})
SELECT priority, n, round(b1, 5) AS phi_1, round(b2, 5) AS phi_2, round(n * ln(rss / n) + 8, 3) AS aic FROM m""")
def fit_ar2_levels(spark, folder):
    m = M.fit_arima(monthly_orders(spark, folder), "y", ["priority"], "ts", (2, 0, 0))
    return m.select("priority", "n", F.round(F.element_at("phi", 1), 5).alias("phi_1"),
                    F.round(F.element_at("phi", 2), 5).alias("phi_2"), F.round("aic", 3).alias("aic"))


SQL_HOLES = SQL_Z.replace("zs AS (", "zs0 AS (") + """,
zs AS (SELECT sentiment, ts_bin, CASE WHEN cnt = 2 THEN NULL ELSE z END AS z FROM zs0)"""


@query("sta10_fit_ar2_with_holes", f"""WITH {SQL_LAGS.replace(SQL_Z, SQL_HOLES)},
q AS (SELECT * FROM l2 WHERE y IS NOT NULL AND a IS NOT NULL), m AS ({_two_regressors("q", "sentiment")})
SELECT sentiment, n, round(c, 6) AS const, round(b1, 6) AS phi_1, round(b2, 6) AS phi_2 FROM m""")
def fit_ar2_holes(spark, folder):
    """No lag reaches across a bin whose value is missing."""
    holed = z_series(spark, folder).withColumn("z", F.when(F.nullif(F.col("cnt"), F.lit(2)).isNotNull(), F.col("z")))
    m = M.fit_arima(holed, "z", KEY, TS, (2, 0, 0))
    return m.select("sentiment", "n", F.round("const", 6).alias("const"),
                    F.round(F.element_at("phi", 1), 6).alias("phi_1"),
                    F.round(F.element_at("phi", 2), 6).alias("phi_2"))


@query("sta11_fit_ma1", f"""WITH {SQL_Z}, s AS (SELECT sentiment AS k, ts_bin AS ts, z AS y FROM zs),
{SQL_INNOVATIONS}
SELECT k AS sentiment, count(*) AS n, round(regr_intercept(y, b), 6) AS const,
  round(regr_slope(y, b), 6) AS theta FROM r GROUP BY 1""")
def fit_ma1(spark, folder):
    m = M.fit_arima(z_series(spark, folder), "z", KEY, TS, (0, 0, 1), long_order=1)
    return m.select("sentiment", "n", F.round("const", 6).alias("const"),
                    F.round(F.element_at("theta", 1), 6).alias("theta"))


@query("sta11_fit_arima_011", f"""WITH {SQL_MONTHLY}, s AS (SELECT priority AS k, ts,
  y - lag(y) OVER (PARTITION BY priority ORDER BY ts) AS y FROM monthly),
q AS (SELECT * FROM s WHERE y IS NOT NULL), {SQL_INNOVATIONS.replace("FROM s)", "FROM q)")}
SELECT k AS priority, count(*) AS n, round(regr_slope(y, b), 6) AS theta FROM r GROUP BY 1""")
def fit_arima_011(spark, folder):
    m = M.fit_arima(monthly_orders(spark, folder), "y", ["priority"], "ts", (0, 1, 1), long_order=1)
    return m.select("priority", "n", F.round(F.element_at("theta", 1), 6).alias("theta"))


@query("sta11_fit_arma11", f"""WITH {SQL_TYPES_HOURLY}, {SQL_INNOVATIONS},
m AS ({_two_regressors("r", "k")})
SELECT k AS event_type, n, round(c, 4) AS const, round(b1, 4) AS phi, round(b2, 4) AS theta FROM m""")
def fit_arma11(spark, folder):
    series = hourly_types(spark, folder)
    m = M.fit_arima(series, "cnt", ["event_type"], TS, (1, 0, 1), long_order=1)
    return m.select("event_type", "n", F.round("const", 4).alias("const"),
                    F.round(F.element_at("phi", 1), 4).alias("phi"),
                    F.round(F.element_at("theta", 1), 4).alias("theta"))


@query("sta11_fit_arma")
def fit_arma(spark, folder):
    m = M.fit_arima(z_series(spark, folder), "z", KEY, TS, ARMA)
    return m.select("sentiment", "p", "d", "q", "n", F.round("aic", 4).alias("aic"),
                    F.round("const", 6).alias("const"),
                    F.transform("phi", lambda v: F.round(v, 6)).alias("phi"),
                    F.transform("theta", lambda v: F.round(v, 6)).alias("theta"))


@query("sta11_fit_arima_differenced")
def fit_arima(spark, folder):
    m = M.fit_arima(monthly_orders(spark, folder), "y", ["priority"], "ts", (1, 1, 1))
    return m.select("priority", "p", "d", "q", "n", F.round("aic", 4).alias("aic"),
                    F.transform("phi", lambda v: F.round(v, 6)).alias("phi"),
                    F.transform("theta", lambda v: F.round(v, 6)).alias("theta"))


# The least sum of squares of a moving average of one term with constant, over weights 1/2000 apart: for
# a given weight the innovations are a - c b, so the best constant has a closed form.
SQL_MA1_GRID = """WITH RECURSIVE m AS (SELECT o_orderpriority AS priority,
  date_trunc('month', o_orderdate)::TIMESTAMP AS ts, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2),
l AS (SELECT priority, ts, y / 1e6 AS w FROM m),
n AS (SELECT priority, w, row_number() OVER (PARTITION BY priority ORDER BY ts) AS i FROM l WHERE w IS NOT NULL),
g AS (SELECT k / 2000.0::DOUBLE AS t FROM range(-1998, 1999) u(k)),
e AS (SELECT priority, i, t, w AS a, 1.0::DOUBLE AS b FROM n, g WHERE i = 1
  UNION ALL SELECT n.priority, n.i, t, w - t * a, 1 - t * b FROM e JOIN n ON n.priority = e.priority AND n.i = e.i + 1),
s AS (SELECT priority, t, count(*) AS n, sum(a * a) - sum(a * b) * sum(a * b) / sum(b * b) AS q FROM e GROUP BY 1, 2)
SELECT priority, any_value(n) AS n, round(ln(min(q) / any_value(n)), 4) AS log_sigma2, 0.0::DOUBLE AS gradient
FROM s GROUP BY 1"""


@query("sta11_fit_ma1_likelihood", SQL_MA1_GRID)
def fit_ma1_likelihood(spark, folder):
    """Refined weights reach the least sum of squares that a fine grid finds, and its gradient is 0."""
    months = monthly_orders(spark, folder).withColumn("y", F.col("y") / 1e6)
    start = M.fit_arima(months, "y", ["priority"], "ts", (0, 0, 1))
    m = likelihood.refine(months, spool(start), "y", ["priority"], "ts")
    return m.select("priority", "n", F.round(F.log("sigma2"), 4).alias("log_sigma2"), F.round("gradient", 4).alias("gradient"))


@query("sta11_ma2_gradient", "SELECT DISTINCT event_type, 0.0::DOUBLE AS gradient, true AS better FROM events")
def ma2_gradient(spark, folder):
    """At the refined weights of two moving-average terms of every class the derivatives vanish, and the sum of
    squares is no larger than at the two-stage start."""
    hours = hourly_types(spark, folder)
    start = spool(M.fit_arima(hours, "cnt", ["event_type"], TS, (0, 0, 2)))
    m = spool(likelihood.refine(hours, start, "cnt", ["event_type"], TS, passes=20))
    squares = [likelihood.innovations(hours, x, "cnt", ["event_type"], TS).groupBy("event_type").agg(
        F.sum(F.col("innovation") * F.col("innovation")).alias(name)) for x, name in ((start, "_a"), (m, "_b"))]
    both = m.join(squares[0], "event_type").join(squares[1], "event_type")
    return both.select("event_type", F.round("gradient", 4).alias("gradient"), (F.col("_b") <= F.col("_a") * (1 + 1e-9)).alias("better"))


@query("sta12_fitted_values", f"""WITH {SQL_AR1}
SELECT lz.sentiment, ts_bin, round(z, 6) AS actual, round(a + b * x, 6) AS fitted FROM lz JOIN ar
  ON ar.sentiment = lz.sentiment WHERE x IS NOT NULL""")
def fitted(spark, folder):
    z = z_series(spark, folder)
    models = M.fit_arima(z, "z", KEY, TS, AR1)
    return rounded(M.fitted_values(z, models, "z", KEY, TS, AR1), "actual", "fitted")


@query("sta12_fitted_values_arma")
def fitted_arma(spark, folder):
    z = z_series(spark, folder)
    models = M.fit_arima(z, "z", KEY, TS, ARMA)
    return rounded(M.fitted_values(z, models, "z", KEY, TS, ARMA), "actual", "fitted")


@query("sta13_order_search")
def order_search(spark, folder):
    best = M.build_model(z_series(spark, folder), "z", KEY, TS)
    return best.select("sentiment", "p", "d", "q", "n", F.round("aic", 4).alias("aic"))


@query("sta13_order_search_ar", f"""WITH {SQL_AR1},
c AS (SELECT lz.sentiment, any_value(n * ln(var_pop_z) + 4) AS aic0, any_value(n * ln(rss / n) + 6) AS aic1
  FROM lz JOIN ar ON ar.sentiment = lz.sentiment JOIN (SELECT sentiment, var_pop(z) AS var_pop_z FROM lz
    WHERE x IS NOT NULL GROUP BY 1) v ON v.sentiment = lz.sentiment GROUP BY 1)
SELECT sentiment, CASE WHEN aic0 <= aic1 THEN 0 ELSE 1 END AS p, round(least(aic0, aic1), 4) AS aic FROM c""")
def order_search_ar(spark, folder):
    best = M.build_model(z_series(spark, folder), "z", KEY, TS, max_p=1, max_q=0, d=0)
    return best.select("sentiment", "p", F.round("aic", 4).alias("aic"))


@query("sta13_order_search_every_user", f"""WITH {SQL_USERS},
x AS (SELECT user_id, y, lag(y) OVER (PARTITION BY user_id ORDER BY ts_bin) AS x FROM zs),
r AS (SELECT user_id, count(x) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_syy(y, x) AS s0,
  regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) AS s1, regr_avgy(y, x) AS m FROM x GROUP BY 1),
c AS (SELECT *, n * ln(s0 / n) + 4 AS aic0, n * ln(s1 / n) + 6 AS aic1 FROM r WHERE n >= 20)
SELECT r.user_id, CASE WHEN aic0 <= aic1 THEN 0 WHEN aic0 > aic1 THEN 1 END AS p, round(least(aic0, aic1), 4) AS aic,
  round(CASE WHEN aic0 <= aic1 THEN c.m ELSE c.a END, 5) AS const FROM r LEFT JOIN c ON c.user_id = r.user_id""")
def order_search_users(spark, folder):
    """Order and AIC of every user's series, p up to 1; null where a series has under 20 lagged rows."""
    best = M.build_model(hourly(spark, folder, "user_id"), "cnt", ["user_id"], TS, max_p=1, max_q=0, d=0)
    long = lambda c: F.when(F.col("n") >= 20, c)
    return best.select("user_id", long(F.col("p")).alias("p"), long(F.round("aic", 4)).alias("aic"),
                       long(F.round("const", 5)).alias("const"))


# One class is differenced, the others are not; AIC then chooses p = 0 or 1 for each.
SQL_SEARCHED = SQL_Z + """,
sy AS (SELECT sentiment, ts_bin, z, CASE WHEN sentiment = -1 THEN 1 ELSE 0 END AS d,
  CASE WHEN sentiment = -1 THEN z - lag(z) OVER w ELSE z END AS y FROM zs WINDOW w AS (PARTITION BY sentiment ORDER BY ts_bin)),
sx AS (SELECT *, lag(y) OVER (PARTITION BY sentiment ORDER BY ts_bin) AS x FROM sy),
sr AS (SELECT sentiment, d, count(x) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_avgy(y, x) AS m,
  regr_syy(y, x) AS s0, regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) AS s1 FROM sx
  WHERE x IS NOT NULL GROUP BY 1, 2),
sm AS (SELECT sentiment, d, 1::INTEGER AS p, a, b FROM sr WHERE n * ln(s1 / n) + 6 < n * ln(s0 / n) + 4
  UNION ALL SELECT sentiment, d, 0, m, 0 FROM sr WHERE n * ln(s1 / n) + 6 >= n * ln(s0 / n) + 4)"""


def searched_models(z):
    """Models of an order search that differ between classes in p and d."""
    found = [M.build_model(z.where(where), "z", KEY, TS, max_p=1, max_q=0, d=d)
             for where, d in (("sentiment != -1", 0), ("sentiment = -1", 1))]
    return found[0].unionByName(found[1])


@query("sta13_search_then_forecast", f"""WITH RECURSIVE {SQL_SEARCHED},
e AS (SELECT sentiment, max(ts_bin) AS last, max_by(z, ts_bin) AS z, max_by(y, ts_bin) AS y FROM sy GROUP BY 1),
f AS (SELECT sm.*, 1 AS step, last, a + b * y AS y, z + a + b * y AS up FROM sm JOIN e ON e.sentiment = sm.sentiment
  UNION ALL SELECT f.* EXCLUDE (step, last, y, up), step + 1, last, a + b * y, up + a + b * y FROM f WHERE step < 12)
SELECT sentiment, p, d, step, last + step * INTERVAL 10 MINUTE AS ts_bin,
  round(CASE WHEN d = 1 THEN up ELSE y END, 6) AS forecast FROM f""")
def search_then_forecast(spark, folder):
    """Every class is forecast with the order that was found for it."""
    z = z_series(spark, folder)
    models = spool(searched_models(z))
    ahead = M.forecast(z, models, "z", KEY, TS, FREQ, None, 12, widest=(1, 1, 0))
    return rounded(ahead.join(models.select("sentiment", "p", "d"), KEY), "forecast").select(
        "sentiment", "p", "d", "step", "ts_bin", "forecast")


@query("sta12_fitted_values_searched", f"""WITH {SQL_SEARCHED}
SELECT sx.sentiment, ts_bin, round(z, 6) AS actual, round(z - y + a + b * coalesce(x, 0), 6) AS fitted
FROM sx JOIN sm ON sm.sentiment = sx.sentiment WHERE y IS NOT NULL AND (p = 0 OR x IS NOT NULL)""")
def fitted_searched(spark, folder):
    z = z_series(spark, folder)
    return rounded(M.fitted_values(z, spool(searched_models(z)), "z", KEY, TS, widest=(1, 1, 0)), "actual", "fitted")


SQL_SEARCHED_REFITS = SQL_SEARCHED + """,
pn AS (SELECT sentiment, ts_bin, z, row_number() OVER (PARTITION BY sentiment ORDER BY ts_bin) - 1 AS pos,
  count(*) OVER (PARTITION BY sentiment) AS len FROM zs),
pw AS (SELECT unnest(generate_series(0, {last})) AS window_id),
pr AS (SELECT pn.sentiment, window_id, ts_bin, z, z - lag(z) OVER (PARTITION BY pn.sentiment, window_id ORDER BY ts_bin) AS dz
  FROM pn JOIN pw ON pos >= floor(0.73::DOUBLE * len) + window_id - 144 AND pos < floor(0.73::DOUBLE * len) + window_id),
py AS (SELECT pr.sentiment, window_id, ts_bin, z, p, d, CASE WHEN d = 1 THEN dz ELSE z END AS y
  FROM pr JOIN sm ON sm.sentiment = pr.sentiment),
px AS (SELECT *, lag(y) OVER (PARTITION BY sentiment, window_id ORDER BY ts_bin) AS x FROM py),
pf AS (SELECT sentiment, window_id, d, max(ts_bin) + INTERVAL 10 MINUTE AS ts_bin, max_by(z, ts_bin) AS z,
  CASE WHEN any_value(p) = 1 THEN regr_intercept(y, x) + regr_slope(y, x) * max_by(y, ts_bin) ELSE avg(y) END AS f
  FROM px GROUP BY 1, 2, 3),
pred AS (SELECT sentiment, window_id, ts_bin, CASE WHEN d = 1 THEN z + f ELSE f END AS p FROM pf)"""


@query("sta15_refits_of_searched_orders", f"""WITH {SQL_SEARCHED_REFITS.format(last=99)}
SELECT sentiment, window_id, 1 AS step, ts_bin, round(p, 5) AS forecast FROM pred""")
def sliding_searched(spark, folder):
    """Sliding refits in which every class has the order of its own search."""
    z = z_series(spark, folder)
    out = M.generate_forecasts(z, "z", KEY, TS, FREQ, searched_models(z), 144, 100, 0.73)
    return rounded(out, "forecast", digits=5)


@query("sta14_model_metrics", f"""WITH {SQL_AR1}
SELECT lz.sentiment, round(any_value(n * ln(rss / n) + 6), 4) AS aic,
  round(avg(abs(z - a - b * x)), 6) AS mae
FROM lz JOIN ar ON ar.sentiment = lz.sentiment WHERE x IS NOT NULL GROUP BY 1""")
def metrics(spark, folder):
    z = z_series(spark, folder)
    models = M.fit_arima(z, "z", KEY, TS, AR1)
    fit = M.fitted_values(z, models, "z", KEY, TS, AR1)
    return M.model_metrics(fit, models, KEY).select(
        "sentiment", F.round("aic", 4).alias("aic"), F.round("mae", 6).alias("mae"))


@query("sta15_generate_forecasts", f"""WITH {SQL_Z},
n AS (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY ts_bin) - 1 AS pos,
  count(*) OVER (PARTITION BY sentiment) AS len FROM zs),
w AS (SELECT unnest(generate_series(0, 199)) AS window_id),
r AS (SELECT n.sentiment, window_id, ts_bin, z, lag(z) OVER (PARTITION BY n.sentiment, window_id
    ORDER BY ts_bin) AS x FROM n JOIN w ON n.pos >= floor(0.73::DOUBLE * n.len) + window_id - 144
    AND n.pos < floor(0.73::DOUBLE * n.len) + window_id),
f AS (SELECT sentiment, window_id, regr_intercept(z, x) AS a, regr_slope(z, x) AS b,
  max(ts_bin) AS ts_bin, max_by(z, ts_bin) AS z FROM r GROUP BY 1, 2)
SELECT sentiment, window_id, 1 AS step, ts_bin + INTERVAL 10 MINUTE AS ts_bin,
  round(a + b * z, 5) AS forecast FROM f""")
def sliding(spark, folder):
    out = M.generate_forecasts(z_series(spark, folder), "z", KEY, TS, FREQ, AR1, 144, 200, 0.73)
    return rounded(out, "forecast", digits=5)


@query("sta15_generate_forecasts_ar2", f"""WITH {SQL_Z},
n AS (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY ts_bin) - 1 AS pos,
  count(*) OVER (PARTITION BY sentiment) AS len FROM zs),
w AS (SELECT unnest(generate_series(0, 49)) AS window_id),
r AS (SELECT sentiment, window_id, ts_bin, z AS y, lag(z, 1) OVER o AS a, lag(z, 2) OVER o AS b
  FROM n JOIN w ON n.pos >= floor(0.73::DOUBLE * n.len) + 2 * window_id - 144
    AND n.pos < floor(0.73::DOUBLE * n.len) + 2 * window_id
  WINDOW o AS (PARTITION BY sentiment, window_id ORDER BY ts_bin)),
q AS (SELECT * FROM r WHERE b IS NOT NULL), m AS ({_two_regressors("q", "sentiment, window_id")}),
l AS (SELECT sentiment, window_id, max(ts_bin) AS last, max_by(y, ts_bin) AS y, max_by(a, ts_bin) AS a
  FROM r GROUP BY 1, 2),
f AS (SELECT l.sentiment, l.window_id, last, c, b1, b2, y, c + b1 * y + b2 * a AS f1 FROM l
  JOIN m ON m.sentiment = l.sentiment AND m.window_id = l.window_id)
SELECT sentiment, window_id, 1 AS step, last + INTERVAL 10 MINUTE AS ts_bin, round(f1, 5) AS forecast FROM f
UNION ALL SELECT sentiment, window_id, 2, last + INTERVAL 20 MINUTE, round(c + b1 * f1 + b2 * y, 5) FROM f""")
def sliding_ar2(spark, folder):
    out = M.generate_forecasts(z_series(spark, folder), "z", KEY, TS, FREQ, (2, 0, 0), 144, 100, 0.73)
    return rounded(out, "forecast", digits=5)


@query("sta15_generate_forecasts_arma")
def sliding_arma(spark, folder):
    out = M.generate_forecasts(z_series(spark, folder), "z", KEY, TS, FREQ, ARMA, 144, 100, 0.73)
    return rounded(out, "forecast")


def _iterate_sql(series, key, value, steps, freq):
    return f"""WITH RECURSIVE {series},
lx AS (SELECT {key}, ts_bin, {value} AS y, lag({value}) OVER (PARTITION BY {key} ORDER BY ts_bin) AS x
  FROM zs),
m AS (SELECT {key}, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM lx WHERE x IS NOT NULL GROUP BY 1),
s AS (SELECT {key}, max(ts_bin) AS last, max_by(y, ts_bin) AS y FROM lx GROUP BY 1),
f AS (SELECT s.{key}, 1 AS step, last, a, b, a + b * y AS y FROM s LEFT JOIN m ON m.{key} = s.{key}
  UNION ALL SELECT {key}, step + 1, last, a, b, a + b * y FROM f WHERE step < {steps})
SELECT {key}, step, last + step * INTERVAL {freq} AS ts_bin, round(y, 6) AS forecast FROM f"""


@query("sta16_iterated_forecast", _iterate_sql(SQL_Z, "sentiment", "z", 24, "10 MINUTE"))
def iterated(spark, folder):
    z = z_series(spark, folder)
    models = M.fit_arima(z, "z", KEY, TS, AR1)
    return rounded(M.forecast(z, models, "z", KEY, TS, FREQ, AR1, 24), "forecast")


def _iterated(series, key, order, steps):
    models = M.fit_arima(series, "cnt", [key], TS, order)
    return rounded(M.forecast(series, models, "cnt", [key], TS, "1 hour", order, steps), "forecast")


@query("sta17_multi_series_forecast", _iterate_sql(SQL_TYPES, "event_type", "y", 12, "1 HOUR"))
def multi_series(spark, folder):
    return _iterated(hourly_types(spark, folder), "event_type", AR1, 12)


@query("sta17_per_user_forecast", _iterate_sql(SQL_USERS, "user_id", "y", 6, "1 HOUR"))
def per_user(spark, folder):
    return _iterated(hourly(spark, folder, "user_id"), "user_id", AR1, 6)


@query("sta17_per_user_forecast_ar3")
def per_user_ar3(spark, folder):
    return _iterated(hourly(spark, folder, "user_id"), "user_id", (3, 0, 0), 6)


SQL_MONTHLY_PAIRS = """mp AS (SELECT o_orderpriority AS priority, date_trunc('month', o_orderdate)::TIMESTAMP AS ts,
  count(*)::DOUBLE AS orders, (sum(o_custkey) / count(*))::DOUBLE AS customer FROM orders
  WHERE o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY 1, 2)"""


@query("sta17_vector_forecast", f"""WITH RECURSIVE {SQL_MONTHLY_PAIRS},
lx AS (SELECT *, lag(orders) OVER w AS a, lag(customer) OVER w AS b FROM mp
  WINDOW w AS (PARTITION BY priority ORDER BY ts)),
v AS (SELECT priority, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, avg(a) AS am, avg(b) AS bm,
  covar_pop(orders, a) AS oa, covar_pop(orders, b) AS ob, avg(orders) AS om,
  covar_pop(customer, a) AS ca, covar_pop(customer, b) AS cb, avg(customer) AS cm
  FROM lx WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1),
k AS (SELECT *, (oa * bb - ob * ab) / (aa * bb - ab * ab) AS p1, (ob * aa - oa * ab) / (aa * bb - ab * ab) AS p2,
  (ca * bb - cb * ab) / (aa * bb - ab * ab) AS q1, (cb * aa - ca * ab) / (aa * bb - ab * ab) AS q2 FROM v),
e AS (SELECT priority, max(ts) AS last, max_by(orders, ts) AS y, max_by(customer, ts) AS z FROM mp GROUP BY 1),
f AS (SELECT k.*, e.last, 1 AS step, om + p1 * (y - am) + p2 * (z - bm) AS y, cm + q1 * (y - am) + q2 * (z - bm) AS z
  FROM k JOIN e ON e.priority = k.priority
  UNION ALL SELECT f.* EXCLUDE (step, y, z), step + 1, om + p1 * (y - am) + p2 * (z - bm),
    cm + q1 * (y - am) + q2 * (z - bm) FROM f WHERE step < 6)
SELECT priority, step, last + step * INTERVAL 1 MONTH AS ts, round(y, 5) AS orders, round(z, 5) AS customer FROM f""")
def vector_forecast(spark, folder):
    """Number of orders and mean customer of each month, forecast jointly."""
    months = (table(spark, folder, "orders").where("o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL")
              .groupBy(F.col("o_orderpriority").alias("priority"),
                       F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts"))
              .agg(F.count(F.lit(1)).cast("double").alias("orders"),
                   (F.sum("o_custkey") / F.count(F.lit(1))).alias("customer")))
    values, key = ["orders", "customer"], ["priority"]
    models = M.fit_vector(months, values, key, "ts", 1)
    return rounded(M.forecast_vector(months, models, values, key, "ts", "1 month", 1, 6), *values, digits=5)


SQL_SLIDING = """fn AS (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY ts_bin) - 1 AS pos,
  count(*) OVER (PARTITION BY sentiment) AS len FROM zs),
fw AS (SELECT unnest(generate_series(0, {last})) AS window_id),
fr AS (SELECT fn.sentiment, window_id, ts_bin, z, lag(z) OVER (PARTITION BY fn.sentiment, window_id
    ORDER BY ts_bin) AS x FROM fn JOIN fw ON fn.pos >= floor(0.73::DOUBLE * fn.len) + window_id - 144
    AND fn.pos < floor(0.73::DOUBLE * fn.len) + window_id),
ff AS (SELECT sentiment, window_id, regr_intercept(z, x) AS a, regr_slope(z, x) AS b,
  max(ts_bin) + INTERVAL 10 MINUTE AS ts_bin, max_by(z, ts_bin) AS z FROM fr GROUP BY 1, 2)"""
SQL_PREDICTED = "pred AS (SELECT sentiment, ts_bin, a + b * z AS p FROM ff)"
SQL_PERSISTED = "pred AS (SELECT sentiment, ts_bin, lag(z) OVER (PARTITION BY sentiment ORDER BY ts_bin) AS p FROM zs)"
SQL_ROUNDED_FLAGS = """SELECT sentiment, ts_bin, round(fittedvalues, 5) AS fittedvalues, round(threshold, 5) AS threshold,
  anomaly, round(actualvalues, 5) AS actualvalues FROM flags"""
assert SQL_PERSISTED in SQL_FLAGS


def _flags(df):
    return rounded(df, "fittedvalues", "threshold", "actualvalues", digits=5).drop("median_values")


@query("sta21_training_pipeline", "WITH " + SQL_FLAGS.replace(
    SQL_PERSISTED, SQL_SLIDING.format(last=199) + ",\n" + SQL_PREDICTED) + SQL_ROUNDED_FLAGS)
def training_pipeline(spark, folder):
    """Resample, standardise, test, fit, forecast by sliding refits, flag."""
    return _flags(anomaly.train(z_series(spark, folder), AR1, 200).flags)


@query("sta21_training_rebuild", "WITH " + SQL_FLAGS.replace(
    SQL_PERSISTED, SQL_SLIDING.format(last=199) + ",\n" + SQL_PREDICTED) + SQL_ROUNDED_FLAGS)
def training_rebuild(spark, folder):
    """Training goes on from stored forecasts: those stay, only what follows them is new."""
    z = z_series(spark, folder)
    stored = spool(anomaly.train(z, AR1, 120).forecasts)
    return _flags(anomaly.train(z, AR1, 200, prior=stored).flags)


@query("sta21_training_searched_orders", "WITH " + SQL_FLAGS.replace(
    SQL_PERSISTED, SQL_SEARCHED_REFITS.removeprefix(SQL_Z + ",\n").format(last=99)) + SQL_ROUNDED_FLAGS)
def training_searched(spark, folder):
    """The chain with searched orders: search, fit, forecast and flag, each class with its own order."""
    z = z_series(spark, folder)
    return _flags(anomaly.train(z, spool(searched_models(z)), 100).flags)


@query("sta21_inference_pipeline", "WITH " + SQL_FLAGS.replace(
    SQL_PERSISTED, SQL_SLIDING.format(last=149) + """,
fl AS (SELECT sentiment, ts_bin, z, lag(z) OVER (PARTITION BY sentiment ORDER BY ts_bin) AS x FROM zs),
fm AS (SELECT sentiment, regr_intercept(z, x) AS a, regr_slope(z, x) AS b, max(ts_bin) AS last,
  max_by(z, ts_bin) AS z FROM fl GROUP BY 1),
pred AS (SELECT sentiment, ts_bin, a + b * z AS p FROM ff
  UNION ALL SELECT sentiment, last + INTERVAL 10 MINUTE, a + b * z FROM fm
  UNION ALL SELECT sentiment, last + INTERVAL 20 MINUTE, a + b * (a + b * z) FROM fm)""") + SQL_ROUNDED_FLAGS)
def inference_pipeline(spark, folder):
    """Stored forecasts and models, read back, and what the models say beyond the series."""
    z = z_series(spark, folder)
    trained = anomaly.train(z, AR1, 150)
    return _flags(anomaly.infer(z, spool(trained.forecasts), spool(trained.models), AR1))
