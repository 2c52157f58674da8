"""PRJ: projection, filters, slices and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.labels import map_values, sentiment_class, sentiment_sign
from tidegauge.operators import position as P, project as J
from tidegauge.operators.stats import reporting_window
from tidegauge.queries import query
from tidegauge.queries.common import (
    EVENT_SENTIMENT, SQL_PRED_PLAIN, SQL_SERIES, SQL_Z, class_series, lag_predictions, z_series,
)
from tidegauge.sources.tables import schema_report, table


@query("prj01_select", "SELECT o_orderkey, o_totalprice FROM orders")
def select(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice")


@query("prj02_derive", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_extendedprice * (1 - l_discount) AS net FROM lineitem""")
def derive(spark, folder):
    li = table(spark, folder, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("prj03_drop", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def drop(spark, folder):
    return table(spark, folder, "customer").drop("c_name", "c_mktsegment")


@query("prj04_rename", """SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region
FROM nation""")
def rename(spark, folder):
    return table(spark, folder, "nation").toDF("key", "name", "region")


@query("prj05_value_map", """SELECT event_id, CASE WHEN event_type IN ('purchase','signup') THEN 1
  WHEN event_type IN ('view','click') THEN 0 WHEN event_type = 'error' THEN -1 END AS sign,
  CASE WHEN event_type IN ('purchase','signup') THEN 1 WHEN event_type IN ('view','click') THEN 2
  WHEN event_type = 'error' THEN 0 END AS target FROM events""")
def value_map(spark, folder):
    name = map_values("event_type", EVENT_SENTIMENT)
    return table(spark, folder, "events").select(
        "event_id", sentiment_sign(name).alias("sign"), sentiment_class(name).alias("target"))


@query("prj06_replace", """SELECT o_orderkey, CASE WHEN o_orderpriority IN
  ('4-NOT SPECIFIED', '5-LOW') THEN 'OTHER' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def replace(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return o.replace(["4-NOT SPECIFIED", "5-LOW"], "OTHER", "o_orderpriority")


@query("prj07_filter", "SELECT event_id, ts, value FROM events WHERE event_type = 'error'")
def filter_eq(spark, folder):
    return table(spark, folder, "events").where("event_type = 'error'").select(
        "event_id", "ts", "value")


@query("prj08_filter_and_or", """SELECT l_orderkey, l_quantity, l_discount, l_returnflag FROM lineitem
WHERE (l_quantity > 45 AND l_discount >= 0.05) OR (l_returnflag = 'R' AND l_quantity < 3)""")
def filter_and_or(spark, folder):
    li = table(spark, folder, "lineitem")
    big = (F.col("l_quantity") > 45) & (F.col("l_discount") >= 0.05)
    small = (F.col("l_returnflag") == "R") & (F.col("l_quantity") < 3)
    return li.where(big | small).select("l_orderkey", "l_quantity", "l_discount", "l_returnflag")


@query("prj09_mask_cells", """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal,
  CASE WHEN c_nationkey > 0 THEN c_nationkey::DOUBLE END AS c_nationkey FROM customer""")
def mask(spark, folder):
    c = table(spark, folder, "customer").select(
        "c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    return J.mask_cells(c, ["c_acctbal", "c_nationkey"], lambda x: x > 0)


@query("prj10_select_labels", """SELECT n_name, n_nationkey FROM nation
WHERE n_name IN ('NATION_3', 'NATION_7')""")
def labels(spark, folder):
    return J.select_labels(table(spark, folder, "nation"), "n_name", ["NATION_3", "NATION_7"],
                           ["n_nationkey"])


@query("prj10_drop_labels", """SELECT n_name, n_nationkey FROM nation
WHERE n_name NOT IN ('NATION_3', 'NATION_7')""")
def drop_labels(spark, folder):
    return J.select_labels(table(spark, folder, "nation"), "n_name", ["NATION_3", "NATION_7"],
                           ["n_nationkey"], drop=True)


SQL_SLICE = """WITH n AS (SELECT o_orderkey, o_orderdate,
  row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_orderdate FROM n WHERE """


def _orders(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_orderdate")


DATE_ORDER = ["o_orderdate", "o_orderkey"]


@query("prj11_positional_slice", SQL_SLICE + "pos >= 100 AND pos < n - 250")
def positional_slice(spark, folder):
    return P.slice_rows(_orders(spark, folder), DATE_ORDER, 100, -250)


@query("prj12_filter_head", SQL_SLICE + "pos < 144")
def filter_head(spark, folder):
    return P.filter_data(_orders(spark, folder), DATE_ORDER, True, num_rows_head=144)


@query("prj12_filter_after_head", SQL_SLICE + "pos >= 144")
def filter_after_head(spark, folder):
    return P.filter_data(_orders(spark, folder), DATE_ORDER, False, num_rows_head=144)


@query("prj12_filter_but_tail", SQL_SLICE + "pos < n - 144")
def filter_but_tail(spark, folder):
    return P.filter_data(_orders(spark, folder), DATE_ORDER, True, num_rows_tail=144)


@query("prj12_filter_tail", SQL_SLICE + "pos >= n - 144")
def filter_tail(spark, folder):
    return P.filter_data(_orders(spark, folder), DATE_ORDER, False, num_rows_tail=144)


@query("prj13_date_slice", """SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'""")
def date_slice(spark, folder):
    return J.date_slice(_orders(spark, folder), "o_orderdate", "1996-01-01", "1996-12-31")


@query("prj13_date_slice_open", """SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '2001-01-01'""")
def date_slice_open(spark, folder):
    return J.date_slice(_orders(spark, folder), "o_orderdate", "2001-01-01")


@query("prj14_reset_index", """SELECT o_orderkey, o_orderdate,
  row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS index FROM orders""")
def reset_index(spark, folder):
    return P.reset_index(_orders(spark, folder), DATE_ORDER)


SPLIT = "2024-01-20 00:00:00"


@query("prj15_split_at_time", f"""WITH {SQL_PRED_PLAIN}
SELECT sentiment, ts_bin, CASE WHEN ts_bin <= TIMESTAMP '{SPLIT}' THEN 'before_or_at' ELSE 'after' END
  AS side FROM pred""")
def split_at_time(spark, folder):
    pred = lag_predictions(z_series(spark, folder)).select("sentiment", "ts_bin")
    before, after = J.split_at(pred, "ts_bin", F.lit(SPLIT).cast("timestamp_ntz"))
    return before.withColumn("side", F.lit("before_or_at")).unionByName(
        after.withColumn("side", F.lit("after")))


@query("prj16_round", "SELECT event_id, round(value / 7, 2) AS value FROM events")
def round_values(spark, folder):
    return table(spark, folder, "events").select("event_id", F.round(F.col("value") / 7, 2)
                                                 .alias("value"))


@query("prj17_threshold_class", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS cls FROM lineitem""")
def threshold_class(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("cls"))


@query("prj18_select_by_type", "SELECT p_name, p_brand, p_type FROM part")
def select_by_type(spark, folder):
    return J.columns_of_type(table(spark, folder, "part"), "string")


@query("prj19_transpose", """WITH t AS (SELECT o_orderpriority AS k, count(*)::DOUBLE AS orders,
  round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1),
u AS (SELECT k, 'orders' AS column_name, orders AS v FROM t UNION ALL SELECT k, 'total', total FROM t)
SELECT column_name, max(v) FILTER (k = '1-URGENT') AS "1-URGENT", max(v) FILTER (k = '2-HIGH') AS "2-HIGH",
  max(v) FILTER (k = '3-MEDIUM') AS "3-MEDIUM", max(v) FILTER (k = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED",
  max(v) FILTER (k = '5-LOW') AS "5-LOW" FROM u GROUP BY 1""")
def transpose(spark, folder):
    t = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return J.transpose(t, "k", ["orders", "total"],
                       ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query("prj20_reporting_window", f"""WITH {SQL_SERIES}
SELECT sentiment, ts_bin, cnt FROM series
WHERE ts_bin >= (SELECT max(ts_bin) FROM series) - INTERVAL 168 HOUR""")
def report_week(spark, folder):
    return reporting_window(class_series(spark, folder), "ts_bin", "week")


@query("prj21_split_by_share", """WITH n AS (SELECT o_orderkey,
  row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN pos < floor(0.73::DOUBLE * n) THEN 'train' ELSE 'test' END AS part FROM n""")
def split_share(spark, folder):
    return P.split_by_share(_orders(spark, folder), DATE_ORDER, 0.73).select("o_orderkey", "part")


@query("prj21_split_last", """WITH n AS (SELECT o_orderkey,
  row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN pos < n - 500 THEN 'train' ELSE 'test' END AS part FROM n""")
def split_last(spark, folder):
    return P.split_last(_orders(spark, folder), DATE_ORDER, 500).select("o_orderkey", "part")


@query("prj22_schema_report", """SELECT * FROM (VALUES
  ('o_orderkey', 'bigint', (SELECT count(o_orderkey) FROM orders)),
  ('o_custkey', 'bigint', (SELECT count(o_custkey) FROM orders)),
  ('o_orderstatus', 'string', (SELECT count(o_orderstatus) FROM orders)),
  ('o_totalprice', 'double', (SELECT count(o_totalprice) FROM orders)),
  ('o_orderdate', 'timestamp_ntz', (SELECT count(o_orderdate) FROM orders)),
  ('o_orderpriority', 'string', (SELECT count(o_orderpriority) FROM orders)))
  AS t(column_name, dtype, non_null)""")
def report_schema(spark, folder):
    return schema_report(table(spark, folder, "orders"))
