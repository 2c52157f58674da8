"""JON: implicit index alignment written as keyed joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import align as A
from tidegauge.operators.stats import median_absolute_error
from tidegauge.queries import query
from tidegauge.queries.common import SQL_SERIES, SQL_Z, class_series, lag_predictions, z_series
from tidegauge.sources.tables import table

SQL_YEARS = """a AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS v FROM orders
  WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1),
b AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS v FROM orders
  WHERE o_orderdate >= TIMESTAMP '1999-01-01' GROUP BY 1)"""


def years(spark, folder):
    """Spend per customer before 1999 and from then on; some customers miss one of them."""
    o = table(spark, folder, "orders")
    spend = F.round(F.sum("o_totalprice"), 2).alias("v")
    key = F.col("o_custkey").alias("k")
    first = o.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    last = o.where(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    return first.groupBy(key).agg(spend), last.groupBy(key).agg(spend)


@query("jon01_aligned_arithmetic", f"""WITH {SQL_YEARS}
SELECT coalesce(a.k, b.k) AS k, round(a.v + b.v, 2) AS total FROM a FULL JOIN b ON a.k = b.k""")
def aligned_add(spark, folder):
    a, b = years(spark, folder)
    return A.aligned(a, b, ["k"], "v", "v", lambda x, y: F.round(x + y, 2), "total")


@query("jon02_aligned_add_fill", f"""WITH {SQL_YEARS}
SELECT coalesce(a.k, b.k) AS k, round(coalesce(a.v, 0) + coalesce(b.v, 0), 2) AS total
FROM a FULL JOIN b ON a.k = b.k""")
def aligned_add_fill(spark, folder):
    a, b = years(spark, folder)
    return A.aligned(a, b, ["k"], "v", "v", lambda x, y: F.round(x + y, 2), "total", fill=0.0)


@query("jon03_aligned_assign", f"""WITH {SQL_SERIES},
neg AS (SELECT ts_bin, cnt FROM series WHERE sentiment = -1)
SELECT s.sentiment, s.ts_bin, s.cnt, coalesce(neg.cnt, 0)::BIGINT AS negative
FROM series s LEFT JOIN neg ON neg.ts_bin = s.ts_bin""")
def assign(spark, folder):
    series = class_series(spark, folder)
    neg = series.where("sentiment = -1")
    return A.assign(series.select("sentiment", "ts_bin", "cnt"), neg, ["ts_bin"], "cnt", "negative", 0)


@query("jon04_reindex", f"""WITH {SQL_SERIES},
m AS (SELECT sentiment, ts_bin + INTERVAL 3 HOUR AS ts_bin, cnt::DOUBLE AS cnt FROM series)
SELECT s.sentiment, s.ts_bin, m.cnt FROM series s LEFT JOIN m ON m.ts_bin = s.ts_bin AND m.sentiment = s.sentiment""")
def reindex(spark, folder):
    series = class_series(spark, folder)
    moved = series.select(
        "sentiment", (F.col("ts_bin") + F.expr("INTERVAL 3 HOURS")).alias("ts_bin"),
        F.col("cnt").cast("double").alias("cnt"))
    return A.reindex(moved, series, ["sentiment", "ts_bin"], "cnt")


@query("jon05_concat_columns", """WITH c AS (SELECT c_custkey,
  row_number() OVER (ORDER BY c_custkey) - 1 AS row_no FROM customer),
p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS row_no FROM part)
SELECT coalesce(c.row_no, p.row_no) AS row_no, c_custkey::DOUBLE AS c_custkey,
  p_partkey::DOUBLE AS p_partkey FROM c FULL JOIN p ON p.row_no = c.row_no""")
def concat_columns(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").cast("double").alias("c_custkey"))
    p = table(spark, folder, "part").select(F.col("p_partkey").cast("double").alias("p_partkey"))
    return A.concat_columns(c, p, ["c_custkey"], ["p_partkey"])


@query("jon06_lookup_join", """WITH m AS (SELECT l_suppkey, round(avg(l_quantity), 6) AS mean_quantity
  FROM lineitem GROUP BY 1)
SELECT s_suppkey, s_name, mean_quantity FROM supplier LEFT JOIN m ON l_suppkey = s_suppkey""")
def lookup_join(spark, folder):
    means = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))
    return A.lookup_join(table(spark, folder, "supplier").select("s_suppkey", "s_name"), means,
                         "s_suppkey")


@query("jon07_positional_pairing", f"""WITH {SQL_Z},
p AS (SELECT sentiment, row_number() OVER (PARTITION BY sentiment ORDER BY ts_bin) AS k, z FROM zs),
q AS (SELECT sentiment, k - 1 AS k, lag(z) OVER (PARTITION BY sentiment ORDER BY k) AS f FROM p)
SELECT p.sentiment, round(median(abs(z - f)), 6) AS medae FROM p JOIN q
  ON q.sentiment = p.sentiment AND q.k = p.k WHERE f IS NOT NULL GROUP BY 1""")
def positional_pairing(spark, folder):
    z = z_series(spark, folder)
    out = median_absolute_error(z, lag_predictions(z), "z", "forecast", ["sentiment"], "ts_bin")
    return out.withColumn("medae", F.round("medae", 6))
