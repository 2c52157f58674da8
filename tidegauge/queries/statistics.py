"""STA: scaling, correlograms, decomposition, errors and anomaly flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import stats as S
from tidegauge.operators.timeseries import series_position
from tidegauge.plans import anomaly
from tidegauge.queries import query
from tidegauge.queries.common import (
    SQL_SERIES, SQL_Z, class_series, labelled_events, lag_predictions, z_series,
)
from tidegauge.sources.tables import table

KEY = ["sentiment"]
TS = "ts_bin"
TRAIN = 1440

SQL_FLAGS = SQL_Z + f""",
pred AS (SELECT sentiment, ts_bin, lag(z) OVER (PARTITION BY sentiment ORDER BY ts_bin) AS p FROM zs),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY ts_bin DESC) AS k
  FROM pred WHERE p IS NOT NULL) WHERE k <= {TRAIN}),
j AS (SELECT kept.sentiment, kept.ts_bin, p, z FROM kept LEFT JOIN zs USING (sentiment, ts_bin)),
e AS (SELECT sentiment, median(abs(z - p)) AS medae FROM j GROUP BY sentiment),
r AS (SELECT j.*, CASE WHEN count(p) OVER w = 4 THEN median(p) OVER w ELSE 0.0 END AS med
  FROM j WINDOW w AS (PARTITION BY sentiment ORDER BY ts_bin ROWS 3 PRECEDING)),
flags AS (SELECT r.sentiment, ts_bin, p AS fittedvalues, med AS median_values,
  med + 1.6448536269514722::DOUBLE / 0.67449::DOUBLE * medae AS threshold,
  CASE WHEN coalesce(z, 0) > med + 1.6448536269514722::DOUBLE / 0.67449::DOUBLE * medae
    THEN 1 ELSE 0 END AS anomaly,
  coalesce(z, 0.0) AS actualvalues FROM r JOIN e ON e.sentiment = r.sentiment)"""


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def flags(spark, folder):
    z = anomaly.prepare(labelled_events(spark, folder))
    return anomaly.flag(z, lag_predictions(z), size=TRAIN)


@query("sta01_standardise", f"""WITH {SQL_Z}
SELECT sentiment, ts_bin, cnt, round(z, 6) AS z FROM zs""")
def standardise(spark, folder):
    return rounded(z_series(spark, folder), "z")


@query("sta02_fit_on_train", f"""WITH {SQL_SERIES},
n AS (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY ts_bin) - 1 AS pos FROM series),
p AS (SELECT sentiment, avg(cnt) AS m, stddev_pop(cnt) AS s FROM n WHERE pos < {TRAIN} GROUP BY 1)
SELECT n.sentiment, ts_bin, cnt, round((cnt - m) / s, 6) AS z FROM n JOIN p
  ON n.sentiment = p.sentiment""")
def fit_on_train(spark, folder):
    placed = series_position(class_series(spark, folder), KEY, TS)
    params = S.fit_standard(placed.where(F.col("pos") < TRAIN), "cnt", KEY)
    return rounded(S.scale(placed.drop("pos"), params, "cnt", KEY, "z"), "z")


@query("sta03_inverse_standardise", f"""WITH {SQL_SERIES}
SELECT sentiment, ts_bin, cnt::DOUBLE AS restored FROM series""")
def inverse_standardise(spark, folder):
    series = class_series(spark, folder)
    params = S.fit_standard(series, "cnt", KEY)
    back = S.unscale(S.scale(series, params, "cnt", KEY, "z"), params, "z", KEY, "restored")
    return rounded(back.select("sentiment", TS, "restored"), "restored")


@query("sta04_min_max_scale", """WITH tr AS (SELECT vec_id, embedding FROM embeddings),
x AS (SELECT vec_id, unnest(generate_series(0, 63)) AS dim, unnest(embedding)::DOUBLE AS v FROM tr),
p AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM x GROUP BY dim)
SELECT vec_id, x.dim::INTEGER AS dim, round((v - lo) / (hi - lo), 6) AS scaled, round(v, 6) AS restored
FROM x JOIN p ON p.dim = x.dim""")
def min_max(spark, folder):
    long = table(spark, folder, "embeddings").select("vec_id", F.posexplode(
        F.col("embedding").cast("array<double>")).alias("dim", "v"))
    params = S.fit_min_max(long, "v", ["dim"])
    scaled = S.scale(long, params, "v", ["dim"], "scaled")
    both = S.unscale(scaled, params, "scaled", ["dim"], "restored")
    return rounded(both.select("vec_id", "dim", "scaled", "restored"), "scaled", "restored")


@query("sta07_acf", f"""WITH {SQL_SERIES},
c AS (SELECT sentiment, cnt - avg(cnt) OVER (PARTITION BY sentiment) AS c,
  row_number() OVER (PARTITION BY sentiment ORDER BY ts_bin) AS pos FROM series),
v AS (SELECT sentiment, sum(c * c) AS s FROM c GROUP BY 1),
l AS (SELECT unnest(generate_series(0, 20)) AS lag)
SELECT a.sentiment, lag::INTEGER AS lag, round(sum(a.c * b.c) / any_value(s), 6) AS acf
FROM l CROSS JOIN c a JOIN c b ON b.sentiment = a.sentiment AND b.pos = a.pos - lag
JOIN v ON v.sentiment = a.sentiment GROUP BY 1, 2""")
def acf(spark, folder):
    return rounded(S.acf(class_series(spark, folder), "cnt", KEY, TS, 20), "acf")


@query("sta08_pacf")
def pacf(spark, folder):
    return rounded(S.pacf(z_series(spark, folder), "z", KEY, TS, 20), "pacf")


def _decompose_sql(period):
    half = period // 2
    return f"""WITH {SQL_SERIES},
t AS (SELECT sentiment, ts_bin, cnt,
  row_number() OVER (PARTITION BY sentiment ORDER BY ts_bin) - 1 AS pos,
  CASE WHEN count(*) OVER f = {2 * half + 1} THEN (sum(cnt) OVER f
    - (lag(cnt, {half}) OVER o + lead(cnt, {half}) OVER o) / 2.0::DOUBLE) / {period}.0::DOUBLE END AS trend
  FROM series WINDOW o AS (PARTITION BY sentiment ORDER BY ts_bin),
  f AS (PARTITION BY sentiment ORDER BY ts_bin ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)),
ph AS (SELECT sentiment, pos % {period} AS phase, avg(cnt - trend) AS m FROM t GROUP BY 1, 2),
s AS (SELECT sentiment, phase, m - avg(m) OVER (PARTITION BY sentiment) AS seasonal FROM ph)
SELECT t.sentiment, ts_bin, cnt, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal,
  round(cnt - trend - seasonal, 6) AS resid
FROM t JOIN s ON s.sentiment = t.sentiment AND s.phase = t.pos % {period}"""


@query("sta09_decompose_24", _decompose_sql(24))
def decompose_24(spark, folder):
    out = S.decompose(class_series(spark, folder), "cnt", 24, KEY, TS)
    return rounded(out, "trend", "seasonal", "resid")


@query("sta09_decompose_144", _decompose_sql(144))
def decompose_144(spark, folder):
    out = S.decompose(class_series(spark, folder), "cnt", 144, KEY, TS)
    return rounded(out, "trend", "seasonal", "resid")


SQL_PRED = SQL_Z + """,
pred AS (SELECT sentiment, ts_bin, p FROM (SELECT sentiment, ts_bin,
  lag(z) OVER (PARTITION BY sentiment ORDER BY ts_bin) AS p FROM zs) WHERE p IS NOT NULL)"""


@query("sta18_median_absolute_error", f"""WITH {SQL_PRED},
a AS (SELECT sentiment, z, row_number() OVER (PARTITION BY sentiment ORDER BY ts_bin) AS pos FROM zs),
b AS (SELECT sentiment, p, row_number() OVER (PARTITION BY sentiment ORDER BY ts_bin) AS pos FROM pred)
SELECT a.sentiment, round(median(abs(z - p)), 6) AS medae FROM a
JOIN b ON b.sentiment = a.sentiment AND b.pos = a.pos GROUP BY 1""")
def medae(spark, folder):
    z = z_series(spark, folder)
    return rounded(S.median_absolute_error(z, lag_predictions(z), "z", "forecast", KEY, TS), "medae")


@query("sta19_mae_mse_rmse", f"""WITH {SQL_PRED},
j AS (SELECT sentiment, z - p AS e FROM zs JOIN pred USING (sentiment, ts_bin))
SELECT sentiment, round(avg(abs(e)), 6) AS mae, round(avg(e * e), 6) AS mse,
  round(sqrt(avg(e * e)), 6) AS rmse FROM j GROUP BY 1""")
def mae_mse_rmse(spark, folder):
    z = z_series(spark, folder)
    j = z.join(lag_predictions(z), ["sentiment", TS])
    return rounded(S.regression_metrics(j, "z", "forecast", KEY).drop("explained_variance"),
                   "mae", "mse", "rmse")


@query("sta20_explained_variance", f"""WITH {SQL_PRED},
j AS (SELECT sentiment, z, z - p AS e FROM zs JOIN pred USING (sentiment, ts_bin))
SELECT sentiment, round(1 - var_pop(e) / var_pop(z), 6) AS explained_variance FROM j GROUP BY 1""")
def explained_variance(spark, folder):
    z = z_series(spark, folder)
    j = z.join(lag_predictions(z), ["sentiment", TS])
    out = S.regression_metrics(j, "z", "forecast", KEY).select("sentiment", "explained_variance")
    return rounded(out, "explained_variance")


@query("sta21_detect_anomalies", f"""WITH {SQL_FLAGS}
SELECT sentiment, ts_bin, round(fittedvalues, 6) AS fittedvalues,
  round(median_values, 6) AS median_values, round(threshold, 6) AS threshold, anomaly,
  round(actualvalues, 6) AS actualvalues FROM flags""")
def detect(spark, folder):
    return rounded(flags(spark, folder), "fittedvalues", "median_values", "threshold", "actualvalues")


@query("sta21_detect_anomalies_positional", f"""WITH {SQL_PRED.replace("OVER (PARTITION BY sentiment ORDER BY ts_bin) AS p", "OVER (PARTITION BY sentiment ORDER BY ts_bin) / 2 AS p")},
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY ts_bin) AS k
  FROM pred) WHERE k <= {TRAIN}),
a AS (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY ts_bin) AS k FROM zs),
e AS (SELECT kept.sentiment, median(abs(z - p)) AS medae FROM kept
  JOIN a ON a.sentiment = kept.sentiment AND a.k = kept.k GROUP BY 1),
r AS (SELECT kept.sentiment, kept.ts_bin, p, z,
  CASE WHEN count(p) OVER w = 4 THEN median(p) OVER w ELSE 0.0 END AS med
  FROM kept LEFT JOIN zs ON zs.sentiment = kept.sentiment AND zs.ts_bin = kept.ts_bin
  WINDOW w AS (PARTITION BY kept.sentiment ORDER BY kept.ts_bin ROWS 3 PRECEDING))
SELECT r.sentiment, ts_bin, round(p, 6) AS fittedvalues, round(med, 6) AS median_values,
  round(med + 1.6448536269514722::DOUBLE / 0.67449::DOUBLE * medae, 6) AS threshold,
  CASE WHEN coalesce(z, 0) > med + 1.6448536269514722::DOUBLE / 0.67449::DOUBLE * medae
    THEN 1 ELSE 0 END AS anomaly, round(coalesce(z, 0.0), 6) AS actualvalues
FROM r JOIN e ON e.sentiment = r.sentiment""")
def detect_positional(spark, folder):
    """Half the previous bin as prediction: plain persistence paired by position is the series
    paired with itself, whose error is 0 and whose flags hang on the last float digit."""
    z = z_series(spark, folder)
    damped = lag_predictions(z).withColumn("forecast", F.col("forecast") / 2)
    out = S.detect_anomalies(damped, z, KEY, TS, TRAIN, "first", positional=True)
    return rounded(out, "fittedvalues", "median_values", "threshold", "actualvalues")


@query("sta22_anomaly_distribution", f"""WITH {SQL_FLAGS}
SELECT sentiment, anomaly, count(*) AS cnt FROM flags GROUP BY 1, 2""")
def anomaly_distribution(spark, folder):
    return flags(spark, folder).groupBy("sentiment", "anomaly").agg(F.count(F.lit(1)).alias("cnt"))


@query("sta23_trend_chart", f"""WITH {SQL_SERIES},
m AS (SELECT sentiment, median(cnt) AS median_line FROM series GROUP BY 1),
s AS (SELECT * FROM series WHERE sentiment IN (1, -1))
SELECT s.sentiment, ts_bin, cnt, median_line,
  ts_bin >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS after_marker
FROM s JOIN m ON m.sentiment = s.sentiment
WHERE ts_bin >= (SELECT max(ts_bin) FROM s) - INTERVAL 24 HOUR""")
def trend_chart(spark, folder):
    ev = table(spark, folder, "events")
    marker = ev.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).scalar()
    return S.trend_chart(class_series(spark, folder), "day", marker)


@query("sta24_anomaly_chart", f"""WITH {SQL_FLAGS},
p AS (SELECT sentiment, avg(cnt) AS m, stddev_pop(cnt) AS s, max(ts_bin) AS last FROM series GROUP BY 1),
lastz AS (SELECT z.sentiment, z.ts_bin + INTERVAL 10 MINUTE AS ts_bin, z.z AS y FROM zs z
  JOIN p ON p.sentiment = z.sentiment AND p.last = z.ts_bin),
n AS (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY ts_bin) AS k FROM zs),
u AS (SELECT sentiment, ts_bin, 'actual' AS series, actualvalues AS y FROM flags
  UNION ALL SELECT sentiment, ts_bin, 'predicted', fittedvalues FROM flags
  UNION ALL SELECT sentiment, ts_bin, 'anomaly', actualvalues FROM flags WHERE anomaly = 1
  UNION ALL SELECT sentiment, ts_bin, 'forecast', y FROM lastz
  UNION ALL SELECT sentiment, ts_bin, 'test', z FROM n WHERE k > {TRAIN})
SELECT u.sentiment, ts_bin, series, round(y * s + m, 6) AS y FROM u JOIN p ON p.sentiment = u.sentiment""")
def anomaly_chart(spark, folder):
    z = z_series(spark, folder)
    params = S.fit_standard(z, "cnt", KEY)
    forecast = z.groupBy("sentiment").agg(
        (F.max(TS) + F.expr("INTERVAL 10 MINUTES")).alias(TS), F.max_by("z", TS).alias("forecast"))
    tail = series_position(z, KEY, TS).where(F.col("pos") >= TRAIN)
    return rounded(S.anomaly_chart(flags(spark, folder), forecast, tail, params, KEY, TS), "y")


@query("sta25_constant_threshold", f"""WITH {SQL_PRED},
e AS (SELECT zs.sentiment, median(abs(z - p)) AS medae FROM zs JOIN pred
  ON pred.sentiment = zs.sentiment AND pred.ts_bin = zs.ts_bin GROUP BY 1),
m AS (SELECT sentiment, median(p) AS med FROM pred GROUP BY 1)
SELECT m.sentiment, round(med, 6) AS median_value, round(medae, 6) AS medae,
  round(med + 1.6448536269514722::DOUBLE / 0.67449::DOUBLE * medae, 6) AS threshold
FROM m JOIN e ON e.sentiment = m.sentiment""")
def constant_threshold(spark, folder):
    z = z_series(spark, folder)
    pred = lag_predictions(z)
    err = z.join(pred, ["sentiment", TS]).groupBy("sentiment").agg(
        F.median(F.abs(F.col("z") - F.col("forecast"))).alias("medae"))
    return rounded(S.constant_threshold(pred, err, KEY), "median_value", "medae", "threshold")


@query("sta26_residuals", f"""WITH {SQL_PRED}
SELECT sentiment, ts_bin, round(z - p, 6) AS residual FROM zs JOIN pred USING (sentiment, ts_bin)""")
def residuals(spark, folder):
    z = z_series(spark, folder)
    j = z.join(lag_predictions(z), ["sentiment", TS])
    return rounded(j.select("sentiment", TS, (F.col("z") - F.col("forecast")).alias("residual")),
                   "residual")
