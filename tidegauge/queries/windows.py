"""WIN: resampling, rolling, lagged and cumulative windows, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.hashing import sql_unit_hash
from tidegauge.functions.text import text_chunks
from tidegauge.operators import position as P, timeseries as W
from tidegauge.queries import query
from tidegauge.queries.common import (
    SQL_EVENTS, SQL_MONTHLY, SQL_SERIES, SQL_Z, class_series, labelled_events, monthly_orders,
    z_series,
)
from tidegauge.sources.tables import table

KEY = ["sentiment"]
TS = "ts_bin"


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("win01_resample_counts", f"WITH {SQL_SERIES} SELECT sentiment, ts_bin, cnt FROM series")
def resample(spark, folder):
    return class_series(spark, folder)


@query("win01_resample_common_span", f"""WITH {SQL_SERIES},
s AS (SELECT unnest(generate_series(min(ts_bin), max(ts_bin), INTERVAL 10 MINUTE)) AS ts_bin FROM bins),
k AS (SELECT DISTINCT sentiment FROM bins)
SELECT k.sentiment, s.ts_bin, coalesce(cnt, 0)::BIGINT AS cnt FROM k CROSS JOIN s
LEFT JOIN bins b ON b.sentiment = k.sentiment AND b.ts_bin = s.ts_bin""")
def resample_common(spark, folder):
    return W.resample_counts(labelled_events(spark, folder).select("ts", "sentiment"), "ts",
                             "10 minutes", KEY, common_span=True)


@query("win01_resample_per_user", """WITH b AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS ts_bin,
  count(*) AS cnt FROM events GROUP BY 1, 2),
s AS (SELECT user_id, unnest(generate_series(min(ts_bin), max(ts_bin), INTERVAL 1 HOUR)) AS ts_bin
  FROM b GROUP BY 1)
SELECT s.user_id, s.ts_bin, coalesce(cnt, 0)::BIGINT AS cnt FROM s
LEFT JOIN b ON b.user_id = s.user_id AND b.ts_bin = s.ts_bin""")
def resample_users(spark, folder):
    ev = table(spark, folder, "events").select("user_id", "ts")
    return W.resample_counts(ev, "ts", "1 hour", ["user_id"])


@query("win02_resample_day", f"""WITH {SQL_EVENTS},
b AS (SELECT sentiment, date_trunc('day', ts)::TIMESTAMP AS ts_bin, count(*) AS cnt FROM ev GROUP BY 1, 2),
s AS (SELECT sentiment, unnest(generate_series(min(ts_bin), max(ts_bin), INTERVAL 1 DAY)) AS ts_bin
  FROM b GROUP BY 1)
SELECT s.sentiment, s.ts_bin, coalesce(cnt, 0)::BIGINT AS cnt FROM s
LEFT JOIN b ON b.sentiment = s.sentiment AND b.ts_bin = s.ts_bin""")
def resample_day(spark, folder):
    return class_series(spark, folder, "1 day")


@query("win03_rolling_median", f"""WITH {SQL_Z}
SELECT sentiment, ts_bin, round(CASE WHEN count(z) OVER w = 4 THEN median(z) OVER w ELSE 0.0 END, 6)
  AS median_values FROM zs WINDOW w AS (PARTITION BY sentiment ORDER BY ts_bin ROWS 3 PRECEDING)""")
def rolling_median(spark, folder):
    out = W.rolling_median(z_series(spark, folder), "z", 4, KEY, TS, "median_values")
    return rounded(out.select("sentiment", TS, "median_values"), "median_values")


@query("win04_rolling_mean_std", f"""WITH {SQL_MONTHLY}
SELECT priority, ts, y, round(CASE WHEN count(y) OVER w = 12 THEN avg(y) OVER w END, 4) AS roll_mean,
  round(CASE WHEN count(y) OVER w = 12 THEN stddev_samp(y) OVER w END, 4) AS roll_std FROM monthly
WINDOW w AS (PARTITION BY priority ORDER BY ts ROWS 11 PRECEDING)""")
def rolling_mean_std(spark, folder):
    out = W.rolling_mean_std(monthly_orders(spark, folder), "y", 12, ["priority"], "ts")
    return rounded(out, "roll_mean", "roll_std", digits=4)


@query("win05_difference", f"""WITH {SQL_MONTHLY}
SELECT priority, ts, round(y - lag(y) OVER (PARTITION BY priority ORDER BY ts), 2) AS diff FROM monthly""")
def difference(spark, folder):
    out = W.difference(monthly_orders(spark, folder), "y", ["priority"], "ts")
    return rounded(out.select("priority", "ts", "diff"), "diff", digits=2)


@query("win06_log_transform", f"""WITH {SQL_MONTHLY}
SELECT priority, ts, round(ln(y), 6) AS log_y,
  round(ln(y) - lag(ln(y)) OVER (PARTITION BY priority ORDER BY ts), 6) AS log_diff FROM monthly""")
def log_transform(spark, folder):
    out = W.log_difference(monthly_orders(spark, folder), "y", ["priority"], "ts")
    return rounded(out.drop("y"), "log_y", "log_diff")


SQL_CUM = SQL_MONTHLY + """,
c AS (SELECT priority, ts, round(sum(y) OVER w, 2) AS cumsum,
  round(product(1 + y / 1e9::DOUBLE) OVER w, 6) AS cumprod, max(y) OVER w AS cummax,
  min(y) OVER w AS cummin FROM monthly
  WINDOW w AS (PARTITION BY priority ORDER BY ts ROWS UNBOUNDED PRECEDING))"""


@query("win07_cumsum", f"WITH {SQL_CUM} SELECT priority, ts, cumsum FROM c")
def cumsum(spark, folder):
    out = W.cumulative(monthly_orders(spark, folder), "y", ["priority"], "ts")
    return rounded(out.select("priority", "ts", "cumsum"), "cumsum", digits=2)


@query("win08_cumprod", f"WITH {SQL_CUM} SELECT priority, ts, cumprod FROM c")
def cumprod(spark, folder):
    growth = monthly_orders(spark, folder).withColumn("y", 1 + F.col("y") / F.lit(1e9))
    out = W.cumulative(growth, "y", ["priority"], "ts")
    return rounded(out.select("priority", "ts", "cumprod"), "cumprod")


@query("win09_cummax_cummin", f"WITH {SQL_CUM} SELECT priority, ts, cummax, cummin FROM c")
def cummax(spark, folder):
    out = W.cumulative(monthly_orders(spark, folder), "y", ["priority"], "ts")
    return out.select("priority", "ts", "cummax", "cummin")


@query("win10_inverse_log_difference", f"""WITH {SQL_MONTHLY}
SELECT priority, ts, round(y, 2) AS restored FROM monthly""")
def inverse_log(spark, folder):
    logged = W.log_difference(monthly_orders(spark, folder), "y", ["priority"], "ts")
    back = W.inverse_log_difference(logged, "log_y", "log_diff", ["priority"], "ts")
    return rounded(back.select("priority", "ts", "restored"), "restored", digits=2)


@query("win11_next_rolling_window", f"""WITH {SQL_SERIES},
n AS (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY ts_bin) - 1 AS pos,
  count(*) OVER (PARTITION BY sentiment) AS len FROM series)
SELECT a.sentiment, a.ts_bin + INTERVAL 1440 MINUTE AS ts_bin, b.cnt FROM n a
JOIN n b ON b.sentiment = a.sentiment AND b.pos = (a.pos + 144) % a.len""")
def next_window(spark, folder):
    return W.next_rolling_window(class_series(spark, folder), 144, KEY, TS, "cnt", "10 minutes")


@query("win12_lag_frames", f"""WITH {SQL_SERIES},
n AS (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY ts_bin) - 1 AS pos FROM series)
SELECT a.sentiment, a.pos, a.cnt::DOUBLE AS target, (12 - (a.pos - b.pos))::INTEGER AS slot, b.cnt::DOUBLE AS lagged
FROM n a JOIN n b ON b.sentiment = a.sentiment AND b.pos BETWEEN a.pos - 12 AND a.pos - 1
WHERE a.pos >= 12 AND (a.pos - 12) % 6 = 0""")
def lag_frames(spark, folder):
    frames = W.lag_frames(class_series(spark, folder), "cnt", 12, KEY, TS, stride=6)
    return frames.select("sentiment", F.col("pos").cast("long").alias("pos"), "target",
                         F.posexplode("frame").alias("slot", "lagged"))


@query("win12_lag_frames_features", f"""WITH h AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts_bin,
  count(*) AS cnt, max(user_id) AS top_user FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts_bin) - 1 AS pos FROM h)
SELECT a.event_type, a.pos, a.cnt::DOUBLE AS target_cnt, a.top_user::DOUBLE AS target_user,
  ((a.pos - b.pos - 2) / 2)::INTEGER AS slot, b.cnt::DOUBLE AS cnt, b.top_user::DOUBLE AS top_user,
  {sql_unit_hash("a.event_type", "a.pos", seed=7)} AS sample_order
FROM n a JOIN n b ON b.event_type IS NOT DISTINCT FROM a.event_type AND b.pos BETWEEN a.pos - 12 AND a.pos - 1
WHERE a.pos BETWEEN 16 AND 500 AND (a.pos - 16) % 3 = 0 AND (b.pos - a.pos + 12) % 2 = 0""")
def lag_frames_features(spark, folder):
    """Two features per slot, thinned and reversed frames, samples in a hashed order."""
    hours = (table(spark, folder, "events").where("ts IS NOT NULL")
             .groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias(TS))
             .agg(F.count(F.lit(1)).alias("cnt"), F.max("user_id").alias("top_user")))
    frames = W.lag_frames(hours, ["cnt", "top_user"], 12, ["event_type"], TS, stride=3, sampling_rate=2,
                          start_index=4, end_index=500, reverse=True, shuffle_seed=7)
    return frames.select(
        "event_type", F.col("pos").cast("long").alias("pos"), F.col("target")[0].alias("target_cnt"),
        F.col("target")[1].alias("target_user"), "sample_order", F.posexplode("frame").alias("slot", "_f")).select(
        "*", F.col("_f")[0].alias("cnt"), F.col("_f")[1].alias("top_user")).drop("_f")


SQL_TRAIL = SQL_SERIES + """,
neg AS (SELECT * FROM series WHERE sentiment = -1), l AS (SELECT max(ts_bin) AS last FROM neg),
t AS (SELECT coalesce(sum(cnt) FILTER (ts_bin >= last - INTERVAL 1 MINUTE), 0)::BIGINT AS "1min",
  coalesce(sum(cnt) FILTER (ts_bin >= last - INTERVAL 10 MINUTE), 0)::BIGINT AS "10min",
  coalesce(sum(cnt) FILTER (ts_bin >= last - INTERVAL 60 MINUTE), 0)::BIGINT AS "60min" FROM neg, l)"""


@query("win13_trailing_counts", f"""WITH {SQL_TRAIL} SELECT * FROM t""")
def trailing(spark, folder):
    return W.trailing_sums(class_series(spark, folder).where("sentiment = -1"), [1, 10, 60])


@query("win13_trailing_event_counts", """WITH l AS (SELECT max(ts) AS last FROM events)
SELECT count(*) FILTER (ts > last - INTERVAL 1 MINUTE) AS "1min",
  count(*) FILTER (ts > last - INTERVAL 10 MINUTE) AS "10min",
  count(*) FILTER (ts > last - INTERVAL 60 MINUTE) AS "60min" FROM events, l""")
def trailing_exact(spark, folder):
    return W.trailing_event_counts(table(spark, folder, "events"), "ts", [1, 10, 60])


@query("win14_summary_append", f"""WITH {SQL_TRAIL}
SELECT 'old' AS run, 0::BIGINT AS "1min", count(*)::BIGINT AS "10min", sum(cnt)::BIGINT AS "60min",
  false AS anomaly_found, false AS last_bin_anomaly FROM neg
UNION ALL SELECT 'new', "1min", "10min", "60min", false, false FROM t""")
def summary(spark, folder):
    neg = class_series(spark, folder).where("sentiment = -1")
    old = neg.agg(F.lit("old").alias("run"), F.lit(0).cast("long").alias("1min"),
                  F.count(F.lit(1)).alias("10min"), F.sum("cnt").alias("60min"),
                  F.lit(False).alias("anomaly_found"), F.lit(False).alias("last_bin_anomaly"))
    return old.unionByName(W.summary_row(neg).withColumn("run", F.lit("new")))


@query("win15_date_range", """WITH b AS (SELECT date_trunc('month', min(o_orderdate))::TIMESTAMP AS lo,
  date_trunc('month', max(o_orderdate))::TIMESTAMP AS hi FROM orders)
SELECT ts AS month_start, (ts + INTERVAL 1 MONTH - INTERVAL 1 DAY)::TIMESTAMP AS month_end
FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS ts FROM b)""")
def date_range(spark, folder):
    def month(agg):
        return F.date_trunc("month", agg).cast("timestamp_ntz")
    b = table(spark, folder, "orders").agg(month(F.min("o_orderdate")).alias("lo"),
                                           month(F.max("o_orderdate")).alias("hi"))
    return W.date_range(b, "lo", "hi", "1 month", "month_start").withColumn(
        "month_end", F.last_day("month_start").cast("timestamp_ntz"))


@query("win15_date_range_10min", """SELECT unnest(generate_series(
  time_bucket(INTERVAL 10 MINUTE, min(ts)), max(ts), INTERVAL 10 MINUTE)) AS ts FROM events""")
def date_range_10min(spark, folder):
    b = table(spark, folder, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    lo = F.window("lo", "10 minutes").alias("_w")
    return W.date_range(b.select(lo, "hi").select(F.col("_w.start").alias("lo"), "hi"), "lo", "hi",
                        "10 minutes")


@query("win16_linspace", """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
  count(*) AS n FROM lineitem)
SELECT i, round(lo + i * ((hi - lo) / (n - 1)), 4) AS x FROM b, (SELECT unnest(generate_series(0,
  (SELECT count(*) FROM lineitem) - 1)) AS i)""")
def linspace(spark, folder):
    li = table(spark, folder, "lineitem")
    stats = li.agg(F.struct(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"),
                            F.count(F.lit(1)).alias("n")))
    grid = spark.range(li.count()).withColumn("_b", stats.scalar())
    step = (F.col("_b.hi") - F.col("_b.lo")) / (F.col("_b.n") - 1)
    return grid.select(F.col("id").alias("i"),
                       F.round(F.col("_b.lo") + F.col("id") * step, 4).alias("x"))


SQL_CHUNK = """ch AS (SELECT doc_id, unnest(generate_series(0, length(text) - 1)) AS pos,
  unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0),
k AS (SELECT doc_id, pos // 101 AS chunk, string_agg(c, '' ORDER BY pos) AS s, count(*) AS n
  FROM ch GROUP BY 1, 2)"""


def chunks(spark, folder):
    return text_chunks(table(spark, folder, "documents"), "doc_id", "text", 101)


@query("win17_sequence_batches", f"""WITH {SQL_CHUNK}
SELECT doc_id, chunk, s AS text FROM k WHERE n = 101""")
def batches(spark, folder):
    return chunks(spark, folder)


@query("win17_event_type_batches", """WITH n AS (SELECT user_id, event_type, ts, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
k AS (SELECT user_id, pos // 8 AS chunk, string_agg(event_type, ',' ORDER BY pos) AS types, count(*) AS n
  FROM n GROUP BY 1, 2)
SELECT user_id, chunk, types FROM k WHERE n = 8""")
def event_batches(spark, folder):
    ev = table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id")
    placed = P.with_position(ev, ["ts", "event_id"], "pos", keys=["user_id"])
    out = W.chunk_sequences(placed, ["user_id"], "pos", "event_type", 8)
    return out.select("user_id", "chunk", F.array_join("items", ",").alias("types"))


@query("win18_input_target", f"""WITH {SQL_CHUNK}
SELECT doc_id, chunk, left(s, 100) AS input, right(s, 100) AS target FROM k WHERE n = 101""")
def input_target(spark, folder):
    return chunks(spark, folder).select(
        "doc_id", "chunk", F.substring("text", 1, 100).alias("input"),
        F.substring("text", 2, 100).alias("target"))


@query("win18_event_input_target", """WITH n AS (SELECT user_id, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
k AS (SELECT user_id, pos // 8 AS chunk, list(event_type ORDER BY pos) AS t FROM n GROUP BY 1, 2)
SELECT user_id, chunk, array_to_string(t[1:7], ',') AS input, array_to_string(t[2:8], ',') AS target FROM k
WHERE len(t) = 8""")
def event_input_target(spark, folder):
    ev = table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id")
    placed = P.with_position(ev, ["ts", "event_id"], "pos", keys=["user_id"])
    pairs = W.input_target(W.chunk_sequences(placed, ["user_id"], "pos", "event_type", 8))
    return pairs.select("user_id", "chunk", F.array_join("input", ",").alias("input"),
                        F.array_join("target", ",").alias("target"))


@query("win19_refit_plan", f"""WITH {SQL_SERIES},
n AS (SELECT sentiment, floor(0.73::DOUBLE * count(*))::BIGINT AS n FROM series GROUP BY 1),
w AS (SELECT sentiment, n, unnest(generate_series(0, 49))::INTEGER AS window_id FROM n)
SELECT sentiment, window_id, n + window_id * 6 - 144 AS start_pos, n + window_id * 6 AS end_pos FROM w""")
def refit_plan(spark, folder):
    n = class_series(spark, folder).groupBy("sentiment").agg(
        F.floor(F.lit(0.73) * F.count(F.lit(1))).alias("n"))
    return W.refit_plan(n, 144, 298, 6).select("sentiment", "window_id", "start_pos", "end_pos")


@query("win20_skip_top_share", """WITH n AS (SELECT o_orderkey, o_totalprice,
  row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_totalprice FROM n WHERE pos >= floor(n * 0.01::DOUBLE)""")
def skip_top(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return P.skip_top_share(o, "o_totalprice", "o_orderkey", 0.01)
