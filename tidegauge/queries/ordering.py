"""ORD and SET: sorting, top-k and row concatenation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators.order import (
    category_order, first_match, head, keep_last, shuffle_rows, tail,
)
from tidegauge.queries import query
from tidegauge.sources.tables import table

PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query("ord01_sort_by_key", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC")
def sort_key(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.col("o_orderkey").desc())


@query("ord02_sort_by_value", """SELECT c_custkey, c_acctbal FROM customer
ORDER BY c_acctbal, c_custkey""")
def sort_value(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", "c_acctbal").orderBy(
        "c_acctbal", "c_custkey")


@query("ord03_top_k", """SELECT o_orderkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def top_k(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.col("o_totalprice").desc(), "o_orderkey").limit(10)


@query("ord04_head", "SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 25")
def head_rows(spark, folder):
    return head(table(spark, folder, "events").select("event_id", "ts"), ["ts", "event_id"], 25)


@query("ord04_tail", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def tail_rows(spark, folder):
    return tail(table(spark, folder, "events").select("event_id", "ts"), ["ts", "event_id"], 25)


@query("ord05_first_match", """SELECT event_id, ts, value FROM events
WHERE event_type = 'purchase' AND value > 100 ORDER BY ts, event_id LIMIT 1""")
def first_row(spark, folder):
    ev = table(spark, folder, "events")
    hit = (F.col("event_type") == "purchase") & (F.col("value") > 100)
    return first_match(ev, hit, ["ts", "event_id"]).select("event_id", "ts", "value")


@query("ord06_category_order", """SELECT o_orderpriority, count(*) AS orders, CASE o_orderpriority
  WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '2-HIGH' THEN 4
  WHEN '1-URGENT' THEN 5 END::BIGINT AS rank FROM orders GROUP BY 1 ORDER BY rank""")
def custom_order(spark, folder):
    counts = table(spark, folder, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"))
    return category_order(counts, "o_orderpriority", PRIORITIES)


@query("ord07_seeded_shuffle", "SELECT doc_id, lang FROM documents")
def shuffle(spark, folder):
    return shuffle_rows(table(spark, folder, "documents").select("doc_id", "lang"), ["doc_id"], 42)


@query("set01_row_concat", """SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment,
  c_acctbal AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def row_concat(spark, folder):
    c = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    s = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("set02_append_history", """WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day,
  count(*) AS cnt FROM events GROUP BY 1),
u AS (SELECT * FROM d WHERE day < TIMESTAMP '2024-01-15'
  UNION ALL SELECT * FROM d WHERE day >= TIMESTAMP '2024-01-15')
SELECT day, cnt FROM u ORDER BY day DESC LIMIT 20""")
def append_history(spark, folder):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    daily = table(spark, folder, "events").groupBy(day).agg(F.count(F.lit(1)).alias("cnt"))
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return keep_last(daily.where(F.col("day") < cut), daily.where(F.col("day") >= cut), ["day"], 20)


@query("set03_drop_duplicates", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def drop_duplicates(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates()
