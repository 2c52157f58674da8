"""AGG: counts, moments, quantiles, pivots, correlation and plot summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import aggregate as A, quantiles as Q
from tidegauge.functions.hashing import sql_unit_hash
from tidegauge.queries import query
from tidegauge.queries.common import SQL_EVENTS, labelled_events
from tidegauge.sources.tables import table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem(spark, folder):
    return table(spark, folder, "lineitem")


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("agg01_row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, folder):
    return lineitem(spark, folder).agg(F.count(F.lit(1)).alias("n"))


@query("agg02_group_count", """SELECT l_returnflag, l_linestatus,
  count(nullif(l_discount, 0)) AS discounted FROM lineitem GROUP BY 1, 2""")
def group_count(spark, folder):
    return lineitem(spark, folder).groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.nullif("l_discount", F.lit(0.0))).alias("discounted"))


@query("agg03_group_mean", """SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS quantity,
  round(avg(l_extendedprice), 6) AS price, round(avg(l_discount), 6) AS discount
FROM lineitem GROUP BY 1, 2""")
def group_mean(spark, folder):
    return lineitem(spark, folder).groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.avg("l_quantity"), 6).alias("quantity"),
        F.round(F.avg("l_extendedprice"), 6).alias("price"),
        F.round(F.avg("l_discount"), 6).alias("discount"))


def _describe_sql(columns, src, keys=""):
    lead = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return " UNION ALL ".join(
        f"""SELECT {lead}'{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 4) AS q25,
  round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75,
  max({c})::DOUBLE AS max FROM {src}{group}""" for c in columns)


@query("agg04_describe", _describe_sql(NUM, "lineitem"))
def describe(spark, folder):
    return rounded(Q.describe(lineitem(spark, folder), NUM), "mean", "std", "q25", "q50", "q75",
                   digits=4)


@query("agg05_group_describe", _describe_sql(["l_quantity", "l_extendedprice"], "lineitem",
                                             "l_returnflag"))
def group_describe(spark, folder):
    out = Q.describe(lineitem(spark, folder), ["l_quantity", "l_extendedprice"], ["l_returnflag"])
    return rounded(out, "mean", "std", "q25", "q50", "q75", digits=4)


@query("agg06_basic_aggregates", """SELECT min(o_totalprice) AS min, max(o_totalprice) AS max,
  round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 4) AS mean,
  round(median(o_totalprice), 4) AS median FROM orders""")
def basic(spark, folder):
    o = table(spark, folder, "orders").select("o_totalprice")
    median = Q.exact_quantiles(o, "o_totalprice", [0.5]).agg(F.max("value")).scalar()
    return o.agg(F.min("o_totalprice").alias("min"), F.max("o_totalprice").alias("max"),
                 F.round(F.sum("o_totalprice"), 2).alias("sum"),
                 F.round(F.avg("o_totalprice"), 4).alias("mean")).withColumn(
        "median", F.round(median, 4))


@query("agg07_idxmin_idxmax", """SELECT o_orderpriority,
  (SELECT o_orderkey FROM orders i WHERE i.o_orderpriority = o.o_orderpriority
    ORDER BY o_totalprice, o_orderkey LIMIT 1) AS idxmin,
  (SELECT o_orderkey FROM orders i WHERE i.o_orderpriority = o.o_orderpriority
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS idxmax
FROM (SELECT DISTINCT o_orderpriority FROM orders) o""")
def extremes(spark, folder):
    return A.extreme_keys(table(spark, folder, "orders"), "o_totalprice", "o_orderkey",
                          ["o_orderpriority"])


@query("agg07_idxmin_idxmax_missing_values", """WITH o AS (SELECT o_custkey % 50 AS k, o_orderkey,
  CASE WHEN o_totalprice >= 250000 THEN o_totalprice END AS v FROM orders),
r AS (SELECT k, o_orderkey, row_number() OVER (PARTITION BY k ORDER BY v NULLS LAST, o_orderkey) AS a,
  row_number() OVER (PARTITION BY k ORDER BY v DESC NULLS LAST, o_orderkey) AS b, v FROM o)
SELECT k, max(CASE WHEN a = 1 AND v IS NOT NULL THEN o_orderkey END) AS idxmin,
  max(CASE WHEN b = 1 AND v IS NOT NULL THEN o_orderkey END) AS idxmax FROM r GROUP BY k""")
def extremes_missing(spark, folder):
    """Null and NaN values are passed over; a group that has no other has no extreme."""
    v = F.when(F.col("o_totalprice") >= 250000, F.col("o_totalprice")).when(F.col("o_orderkey") % 2 == 0, F.lit(float("nan")))
    rows = table(spark, folder, "orders").select((F.col("o_custkey") % 50).alias("k"), "o_orderkey", v.alias("v"))
    return A.extreme_keys(rows, "v", "o_orderkey", ["k"])


@query("agg07_idxmin_idxmax_strings", """SELECT p_brand, arg_min(p_partkey, (p_type, p_partkey)) AS idxmin,
  (SELECT min(p_partkey) FROM part i WHERE i.p_brand = part.p_brand AND i.p_type = max(part.p_type)) AS idxmax
FROM part GROUP BY p_brand""")
def extremes_strings(spark, folder):
    return A.extreme_keys(table(spark, folder, "part"), "p_type", "p_partkey", ["p_brand"])


@query("agg08_unique", "SELECT DISTINCT p_brand, p_type FROM part")
def unique(spark, folder):
    return table(spark, folder, "part").select("p_brand", "p_type").distinct()


@query("agg08_nunique", """SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers,
  count(DISTINCT nullif(l_discount, 0)) AS discounts FROM lineitem GROUP BY 1""")
def nunique(spark, folder):
    return lineitem(spark, folder).groupBy("l_returnflag").agg(
        F.countDistinct("l_suppkey").alias("suppliers"),
        F.countDistinct(F.nullif("l_discount", F.lit(0.0))).alias("discounts"))


@query("agg09_value_counts", """SELECT p_brand, count(*) AS cnt FROM part GROUP BY 1
ORDER BY cnt DESC, p_brand""")
def value_counts(spark, folder):
    return A.value_counts(table(spark, folder, "part"), "p_brand")


@query("agg10_mean_absolute_deviation", """SELECT round(avg(abs(l_extendedprice - m)), 4) AS mad
FROM lineitem, (SELECT avg(l_extendedprice) AS m FROM lineitem)""")
def mad(spark, folder):
    return rounded(A.mean_absolute_deviation(lineitem(spark, folder), "l_extendedprice"), "mad",
                   digits=4)


@query("agg10_group_mean_absolute_deviation", """WITH m AS (SELECT l_returnflag, avg(l_quantity) AS m
  FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, round(avg(abs(l_quantity - m)), 6) AS mad
FROM lineitem l JOIN m ON m.l_returnflag = l.l_returnflag GROUP BY 1""")
def group_mad(spark, folder):
    return rounded(A.mean_absolute_deviation(lineitem(spark, folder), "l_quantity",
                                             ["l_returnflag"]), "mad")


@query("agg11_mode", """WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem
  GROUP BY 1, 2)
SELECT l_returnflag, l_quantity AS mode FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag
  ORDER BY n DESC, l_quantity) AS k FROM c) WHERE k = 1""")
def mode(spark, folder):
    return A.mode(lineitem(spark, folder), "l_quantity", ["l_returnflag"])


@query("agg12_product", """SELECT p_type, round(product(1 + p_size / 10000.0::DOUBLE), 6) AS growth
FROM part GROUP BY 1""")
def product(spark, folder):
    return table(spark, folder, "part").groupBy("p_type").agg(
        F.round(F.product(1 + F.col("p_size") / F.lit(10000.0)), 6).alias("growth"))


def _moments(spark, folder, *names, digits=4):
    m = A.moments("l_extendedprice")
    return lineitem(spark, folder).groupBy("l_returnflag").agg(
        *[F.round(m[n], digits).alias(n) for n in names])


@query("agg13_sample_std_var", """SELECT l_returnflag, round(stddev_samp(l_extendedprice), 4) AS std,
  round(var_samp(l_extendedprice), 2) AS var FROM lineitem GROUP BY 1""")
def sample_moments(spark, folder):
    return _moments(spark, folder, "std", "var").withColumn("var", F.round("var", 2))


@query("agg14_population_std_var", """SELECT l_returnflag,
  round(stddev_pop(l_extendedprice), 4) AS std_pop,
  round(var_pop(l_extendedprice), 2) AS var_pop FROM lineitem GROUP BY 1""")
def population_moments(spark, folder):
    return _moments(spark, folder, "std_pop", "var_pop").withColumn("var_pop",
                                                                    F.round("var_pop", 2))


@query("agg15_sem", """SELECT l_returnflag,
  round(stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)), 4) AS sem
FROM lineitem GROUP BY 1""")
def sem(spark, folder):
    return _moments(spark, folder, "sem")


@query("agg16_skew", """SELECT l_returnflag, round(skewness(l_extendedprice), 6) AS skew
FROM lineitem GROUP BY 1""")
def skew(spark, folder):
    return _moments(spark, folder, "skew", digits=6)


@query("agg17_kurt", """SELECT l_returnflag, round(kurtosis(l_extendedprice), 6) AS kurt
FROM lineitem GROUP BY 1""")
def kurt(spark, folder):
    return _moments(spark, folder, "kurt", digits=6)


@query("agg18_quantiles", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
  round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1""")
def quantiles(spark, folder):
    out = Q.quantile_columns(lineitem(spark, folder), "l_extendedprice",
                             {"p10": 0.1, "p50": 0.5, "p99": 0.99}, ["l_returnflag"])
    return rounded(out, "p10", "p50", "p99", digits=4)


@query("agg18_percentile_99", """SELECT round(quantile_cont(value, 0.99), 4) AS p99 FROM events""")
def percentile_99(spark, folder):
    return rounded(Q.quantile_columns(table(spark, folder, "events"), "value", {"p99": 0.99}), "p99",
                   digits=4)


@query("agg19_abs", "SELECT c_custkey, abs(c_acctbal - 5000) AS distance FROM customer")
def absolute(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", F.abs(F.col("c_acctbal") - 5000).alias("distance"))


@query("agg20_daily_class_pivot", f"""WITH {SQL_EVENTS},
d AS (SELECT airline_sentiment AS s, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n
  FROM ev GROUP BY 1, 2),
sp AS (SELECT s, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM d GROUP BY s),
f AS (SELECT sp.s, sp.day, coalesce(n, 0) AS n FROM sp LEFT JOIN d ON d.s = sp.s AND d.day = sp.day)
SELECT day, (sum(n) FILTER (s = 'negative'))::BIGINT AS negative,
  (sum(n) FILTER (s = 'neutral'))::BIGINT AS neutral,
  (sum(n) FILTER (s = 'positive'))::BIGINT AS positive, sum(n)::BIGINT AS total FROM f GROUP BY 1""")
def daily_pivot(spark, folder):
    return A.daily_class_pivot(labelled_events(spark, folder).select("ts", "airline_sentiment"), "ts",
                               "airline_sentiment", ["negative", "neutral", "positive"])


@query("agg21_row_sum", """SELECT p_partkey, p_retailprice + coalesce(nullif(p_size, 1), 0) AS total
FROM part""")
def row_sums(spark, folder):
    p = table(spark, folder, "part").select(
        "p_partkey", "p_retailprice", F.nullif("p_size", F.lit(1)).alias("size"))
    return p.select("p_partkey", A.row_sum(["p_retailprice", "size"]).alias("total"))


@query("agg21_column_sum", """SELECT round(sum(l_quantity), 2) AS quantity,
  round(sum(l_extendedprice), 2) AS price FROM lineitem""")
def column_sums(spark, folder):
    return lineitem(spark, folder).agg(F.round(F.sum("l_quantity"), 2).alias("quantity"),
                                       F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("agg22_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for a in NUM for b in NUM))
def correlations(spark, folder):
    return rounded(A.correlation_matrix(lineitem(spark, folder), NUM), "corr")


@query("agg23_correlation_with_target", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(corr({c}, l_extendedprice), 6) AS corr FROM lineitem"
    for c in NUM if c != "l_extendedprice"))
def correlation_target(spark, folder):
    return rounded(A.correlation_with(lineitem(spark, folder), "l_extendedprice", NUM), "corr")


@query("agg24_conditional_ratio", """SELECT l_linestatus, round(count(*) FILTER (l_returnflag = 'R')
  / nullif(count(*) FILTER (l_returnflag = 'A'), 0)::DOUBLE, 6) AS ratio FROM lineitem GROUP BY 1""")
def ratio(spark, folder):
    out = A.conditional_ratio(lineitem(spark, folder), "l_linestatus",
                              F.col("l_returnflag") == "R", F.col("l_returnflag") == "A")
    return rounded(out, "ratio")


@query("agg25_count_by_hue", """SELECT o_orderpriority, o_orderstatus, count(*) AS cnt FROM orders
GROUP BY 1, 2""")
def count_hue(spark, folder):
    return table(spark, folder, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("cnt"))


@query("agg26_histogram", """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi
  FROM lineitem),
c AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 20.0::DOUBLE)), 19)::INTEGER AS bin,
  count(*) AS cnt FROM lineitem, s GROUP BY 1),
b AS (SELECT unnest(generate_series(0, 19)) AS bin)
SELECT b.bin::INTEGER AS bin, round(lo + b.bin * ((hi - lo) / 20.0::DOUBLE), 6) AS lower,
  round(lo + (b.bin + 1) * ((hi - lo) / 20.0::DOUBLE), 6) AS upper, coalesce(cnt, 0)::BIGINT AS cnt
FROM b CROSS JOIN s LEFT JOIN c ON c.bin = b.bin""")
def histogram(spark, folder):
    return rounded(A.histogram(lineitem(spark, folder), "l_extendedprice", 20), "lower", "upper")


@query("agg27_box_summary", """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1,
  median(l_extendedprice) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT q.l_returnflag, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median,
  round(any_value(q3), 4) AS q3,
  min(l_extendedprice) FILTER (l_extendedprice >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
  max(l_extendedprice) FILTER (l_extendedprice <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1))
    AS outliers
FROM lineitem l JOIN q ON q.l_returnflag = l.l_returnflag GROUP BY 1""")
def box(spark, folder):
    out = Q.box_summary(lineitem(spark, folder), "l_extendedprice", ["l_returnflag"])
    return rounded(out, "q1", "median", "q3", digits=4)


@query("agg28_time_bounds", "SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def bounds(spark, folder):
    return A.time_bounds(table(spark, folder, "events"), "ts")


@query("agg29_random_sample", f"""SELECT o_orderkey, o_totalprice FROM orders
WHERE {sql_unit_hash('o_orderkey', seed=42)} < 0.1""")
def sample(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return A.sample_rows(o, ["o_orderkey"], 0.1, seed=42)


@query("agg30_scatter_points", f"""SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE {sql_unit_hash('o_orderkey', seed=42)} < 0.1""")
def scatter(spark, folder):
    return A.sample_points(table(spark, folder, "orders"), "o_custkey", "o_totalprice",
                           ["o_orderkey"], 0.1, seed=42)
