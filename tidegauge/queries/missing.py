"""NUL: missing data. Nulls are derived from the tables with ``nullif``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import missing as M
from tidegauge.queries import query
from tidegauge.sources.tables import table

SQL_HOLES = """h AS (SELECT p_partkey, nullif(p_type, 'PROMO') AS p_type,
  CASE WHEN p_size > 10 THEN p_size::DOUBLE END AS p_size,
  nullif(p_brand, 'Brand#3') AS p_brand, p_retailprice FROM part)"""


def holes(spark, folder):
    """part with nulls in type, size and brand."""
    return table(spark, folder, "part").select(
        "p_partkey", F.nullif("p_type", F.lit("PROMO")).alias("p_type"),
        F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("p_size"),
        F.nullif("p_brand", F.lit("Brand#3")).alias("p_brand"), "p_retailprice")


def _per_column(expr):
    cols = ["p_partkey", "p_type", "p_size", "p_brand", "p_retailprice"]
    return f"WITH {SQL_HOLES} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {expr.format(c=c)} FROM h" for c in cols)


@query("nul01_null_count", _per_column("count(*) - count({c}) AS nulls"))
def null_count(spark, folder):
    return M.null_counts(holes(spark, folder)).drop("null_pct")


@query("nul02_null_percent", _per_column(
    "round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 6) AS null_pct"))
def null_percent(spark, folder):
    return M.null_counts(holes(spark, folder)).select(
        "column_name", F.round("null_pct", 6).alias("null_pct"))


@query("nul03_drop_rows", f"""WITH {SQL_HOLES} SELECT * FROM h
WHERE p_type IS NOT NULL AND p_size IS NOT NULL AND p_brand IS NOT NULL""")
def drop_rows(spark, folder):
    return holes(spark, folder).dropna("any")


@query("nul04_drop_columns", "SELECT p_partkey, p_retailprice FROM part")
def drop_columns(spark, folder):
    return M.drop_null_columns(holes(spark, folder))


@query("nul05_drop_rows_thresh", f"""WITH {SQL_HOLES} SELECT * FROM h
WHERE (p_type IS NOT NULL)::INT + (p_size IS NOT NULL)::INT + (p_brand IS NOT NULL)::INT >= 2""")
def drop_thresh(spark, folder):
    return holes(spark, folder).dropna(thresh=2, subset=["p_type", "p_size", "p_brand"])


@query("nul06_fill_constant", f"""WITH {SQL_HOLES} SELECT p_partkey, coalesce(p_type, 'FILL') AS p_type,
  coalesce(p_size, 0) AS p_size, p_brand, p_retailprice FROM h""")
def fill_constant(spark, folder):
    return holes(spark, folder).fillna({"p_type": "FILL", "p_size": 0.0})


@query("nul07_fill_mean", f"""WITH {SQL_HOLES} SELECT p_partkey,
  round(coalesce(p_size, (SELECT avg(p_size) FROM h)), 6) AS p_size FROM h""")
def fill_mean(spark, folder):
    return M.fill_mean(holes(spark, folder), ["p_size"]).select(
        "p_partkey", F.round("p_size", 6).alias("p_size"))


@query("nul08_fill_group_mean", f"""WITH {SQL_HOLES},
m AS (SELECT p_brand, avg(p_size) AS m FROM h WHERE p_brand IS NOT NULL GROUP BY 1)
SELECT p_partkey, h.p_brand, round(coalesce(p_size, m), 6) AS p_size
FROM h LEFT JOIN m ON m.p_brand = h.p_brand""")
def fill_group_mean(spark, folder):
    out = M.fill_group_mean(holes(spark, folder).select("p_partkey", "p_brand", "p_size"),
                            "p_size", "p_brand")
    return out.select("p_partkey", "p_brand", F.round("p_size", 6).alias("p_size"))


@query("nul09_coercing_time_parse", """SELECT event_id, try_cast(CASE WHEN event_type = 'error'
  THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS parsed FROM events""")
def coerce_time(spark, folder):
    ev = table(spark, folder, "events")
    text = F.when(F.col("event_type") == "error", "not a time").otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return ev.select("event_id", text.alias("t")).select(
        "event_id", M.parse_time("t").cast("timestamp_ntz").alias("parsed"))
