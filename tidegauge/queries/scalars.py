"""FUN and UDF: scalar, array, text and encoding functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import encode as E, scalars as S
from tidegauge.functions.text import (
    character_vocabulary, characters, decode_characters, encode_characters,
)
from tidegauge.functions.udfs import apply_vectorised
from tidegauge.functions.hashing import sql_unit_hash
from tidegauge.queries import query
from tidegauge.sources.tables import table


@query("fun01_first_character", "SELECT c_custkey, left(c_mktsegment, 1) AS initial FROM customer")
def first_char(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", S.first_character("c_mktsegment").alias("initial"))


@query("fun02_by_first_character", """SELECT c_custkey, CASE WHEN left(c_mktsegment, 1) = 'M'
  THEN 'machine' ELSE 'other' END AS kind FROM customer""")
def by_first_char(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", S.by_first_character("c_mktsegment", "M", "machine", "other").alias("kind"))


@query("fun03_prefix_int", """SELECT o_orderkey, try_cast(trim(left(o_orderpriority, 1)) AS INTEGER) AS rank
FROM orders""")
def prefix(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", S.prefix_int("o_orderpriority", 1).alias("rank"))


@query("fun04_suffix", """SELECT c_custkey, right(c_name, 5) AS tail,
  try_cast(right(c_name, 5) AS INTEGER) AS num FROM customer""")
def suffix(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", S.suffix("c_name", 5).alias("tail"), S.suffix_int("c_name", 5).alias("num"))


@query("fun05_frequency_digits", """SELECT event_id,
  (event_id % 60)::INTEGER AS digits FROM events""")
def frequency(spark, folder):
    ev = table(spark, folder, "events").select(
        "event_id", F.concat((F.col("event_id") % 60).cast("string"), F.lit("min")).alias("freq"))
    return ev.select("event_id", S.frequency_number("freq").alias("digits"))


@query("fun06_parse_time", """SELECT event_id, strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'),
  '%Y-%m-%d %H:%M:%S') AS parsed FROM events""")
def parse(spark, folder):
    return table(spark, folder, "events").select("event_id", F.to_timestamp(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd HH:mm:ss")
        .cast("timestamp_ntz").alias("parsed"))


@query("fun07_month_year", """SELECT o_orderkey, month(o_orderdate)::INTEGER AS month,
  year(o_orderdate)::INTEGER AS year FROM orders""")
def month_year(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year"))


@query("fun08_to_epoch", "SELECT event_id, floor(epoch(ts))::BIGINT AS seconds FROM events")
def to_epoch(spark, folder):
    return table(spark, folder, "events").select("event_id", S.to_epoch("ts").alias("seconds"))


@query("fun09_from_epoch", """SELECT event_id, to_timestamp(floor(epoch(ts))::BIGINT)
  AT TIME ZONE 'UTC' AS ts FROM events""")
def from_epoch(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", S.from_epoch(S.to_epoch("ts")).cast("timestamp_ntz").alias("ts"))


@query("fun10_attach_utc", """SELECT event_id, epoch_us(ts) AS micros FROM events""")
def attach_utc(spark, folder):
    return table(spark, folder, "events").select("event_id", F.unix_micros(S.as_utc("ts"))
                                                 .alias("micros"))


@query("fun11_format_time", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '+0000' AS text
FROM events""")
def format_time(spark, folder):
    return table(spark, folder, "events").select("event_id", S.format_time("ts").alias("text"))


@query("fun12_shift_time", """SELECT event_id, ts - INTERVAL 60 MINUTE AS earlier,
  ts + INTERVAL 90 MINUTE AS later FROM events""")
def shift(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", S.shift_time("ts", -60).alias("earlier"), S.shift_time("ts", 90).alias("later"))


@query("fun13_math", """SELECT event_id, round(sqrt(value), 6) AS root, round(exp(value / 1000), 6) AS e,
  round(sin(value), 6) AS sine, round(ln(value + 1), 6) AS log, round(power(value, 1.5), 4) AS pow
FROM events""")
def math(spark, folder):
    v = F.col("value")
    return table(spark, folder, "events").select(
        "event_id", F.round(F.sqrt(v), 6).alias("root"), F.round(F.exp(v / 1000), 6).alias("e"),
        F.round(F.sin(v), 6).alias("sine"), F.round(F.ln(v + 1), 6).alias("log"),
        F.round(F.pow(v, 1.5), 4).alias("pow"))


@query("fun14_arithmetic", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  l_quantity + l_discount AS plus, l_quantity * l_discount AS times,
  round(l_quantity / nullif(l_tax, 0), 6) AS per_tax,
  CASE WHEN l_discount = 0 THEN 'infinite' ELSE round(1 / l_discount, 4)::VARCHAR END AS reciprocal
FROM lineitem""")
def arithmetic(spark, folder):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    inverse = F.round(S.reciprocal("l_discount"), 4)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (q + d).alias("plus"),
        (q * d).alias("times"), F.round(F.try_divide(q, t), 6).alias("per_tax"),
        F.when(S.divide(F.lit(1.0), d) == float("inf"), "infinite").otherwise(
            inverse.cast("string")).alias("reciprocal"))


@query("fun15_array_ops", """SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last,
  round(list_sum(embedding[3:10]::DOUBLE[]), 5) AS part_sum,
  len(list_filter(embedding, lambda x: x > 0))::INTEGER AS positives,
  round(list_sum(list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x < 0 THEN 0 ELSE x END)), 5) AS clipped
FROM embeddings""")
def arrays(spark, folder):
    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    v = F.col("embedding").cast("array<double>")
    return table(spark, folder, "embeddings").select(
        "vec_id", F.element_at(v, 1).alias("first"), F.element_at(v, -1).alias("last"),
        F.round(total(F.slice(v, 3, 8)), 5).alias("part_sum"),
        F.size(F.filter(v, lambda x: x > 0)).alias("positives"),
        F.round(total(F.transform(v, lambda x: F.when(x < 0, 0.0).otherwise(x))), 5)
        .alias("clipped"))


@query("fun16_reshape", """SELECT vec_id, r::INTEGER AS row_no, embedding[r * 8 + 3]::DOUBLE AS third,
  round(list_sum(embedding[r * 8 + 1 : r * 8 + 8]::DOUBLE[]), 5) AS row_total
FROM embeddings, (SELECT unnest(generate_series(0, 7)) AS r)""")
def reshape(spark, folder):
    v = F.col("embedding").cast("array<double>")
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(v, r * 8 + 1, F.lit(8)))
    rows = table(spark, folder, "embeddings").select("vec_id", F.posexplode(grid)
                                                     .alias("row_no", "_r"))
    return rows.select("vec_id", "row_no", F.element_at("_r", 3).alias("third"), F.round(
        F.aggregate("_r", F.lit(0.0), lambda s, x: s + x), 5).alias("row_total"))


@query("fun17_random_columns", f"""SELECT c_custkey, {sql_unit_hash('c_custkey', seed=101)} AS uniform,
  round(sqrt(-2 * ln(1 - {sql_unit_hash('c_custkey', seed=102)})) * cos(2 * pi() * {sql_unit_hash('c_custkey', seed=103)}), 6)
    AS normal, floor({sql_unit_hash('c_custkey', seed=104)} * 100)::INTEGER AS integer FROM customer""")
def random_columns(spark, folder):
    return E.random_columns(table(spark, folder, "customer").select("c_custkey"), ["c_custkey"], 101).withColumn(
        "normal", F.round("normal", 6))


@query("fun18_dummies", """SELECT o_orderkey, (o_orderstatus = 'O')::INTEGER AS "o_orderstatus_O",
  (o_orderstatus = 'P')::INTEGER AS "o_orderstatus_P" FROM orders""")
def dummies(spark, folder):
    return E.dummies(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"),
                     "o_orderstatus", ["F", "O", "P"], drop_first=True)


@query("fun19_binarise", """SELECT doc_id, (lang = 'de')::INTEGER AS de, (lang = 'en')::INTEGER AS en,
  (lang = 'es')::INTEGER AS es, (lang = 'fr')::INTEGER AS fr FROM documents""")
def binarise(spark, folder):
    d = table(spark, folder, "documents").select(
        "doc_id", E.binarise("lang", ["fr", "en", "de", "es"]).alias("_b"))
    return d.select("doc_id", *[F.get("_b", F.lit(i)).alias(n)
                                for i, n in enumerate(["de", "en", "es", "fr"])])


SQL_VOCAB = """c AS (SELECT doc_id, unnest(generate_series(0, length(text) - 1)) AS pos,
  unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0),
v AS (SELECT ch, (row_number() OVER (ORDER BY encode(ch)) - 1)::INTEGER AS code
  FROM (SELECT DISTINCT ch FROM c))"""


def _chars(spark, folder):
    return characters(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


@query("fun20_character_vocabulary", f"WITH {SQL_VOCAB} SELECT ch, code FROM v")
def vocabulary(spark, folder):
    return character_vocabulary(table(spark, folder, "documents").select("text"), "text")


@query("fun21_encode_characters", f"""WITH {SQL_VOCAB}
SELECT doc_id, count(*) AS chars, sum(code)::BIGINT AS code_sum, sum(code * (pos % 97))::BIGINT AS check_sum
FROM c JOIN v ON v.ch = c.ch GROUP BY 1""")
def encode_chars(spark, folder):
    vocab = character_vocabulary(table(spark, folder, "documents").select("text"), "text")
    coded = encode_characters(_chars(spark, folder), vocab).select("doc_id", F.posexplode("codes").alias("pos", "code"))
    return coded.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chars"), F.sum("code").alias("code_sum"),
        F.sum(F.col("code") * (F.col("pos") % 97)).alias("check_sum"))


@query("fun21_decode_characters", "SELECT doc_id, text FROM documents WHERE length(text) > 0")
def decode_chars(spark, folder):
    vocab = character_vocabulary(table(spark, folder, "documents").select("text"), "text")
    coded = encode_characters(_chars(spark, folder), vocab).select("doc_id", "codes")
    decoded = decode_characters(coded, vocab).select("doc_id", F.array_join("chars", "").alias("text"))
    # whole texts are grouped; characters of texts that share an id are put in order of their positions
    texts = decoded.groupBy("doc_id").agg(F.collect_list("text").alias("_t"))
    placed = F.flatten(F.transform("_t", lambda t: F.transform(F.split(t, ""), lambda c, i: F.struct(i.alias("pos"), c.alias("ch")))))
    merged = F.array_join(F.transform(F.sort_array(placed), lambda s: s["ch"]), "")
    return texts.select("doc_id", F.when(F.size("_t") > 1, merged).otherwise(F.get("_t", F.lit(0))).alias("text"))


@query("fun22_json_array", """SELECT event_id, user_id, event_type, value::DOUBLE AS value,
  json_extract(props, '$.k')::INTEGER AS k FROM events""")
def json_array(spark, folder):
    from tidegauge.sources.events import from_message, to_message
    ev = table(spark, folder, "events")
    ev = ev.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    body = ev.select("event_id", to_message(ev, "ts", ["user_id", "event_type", "value", "k"])
                     .alias("body"))
    return from_message(body, "body", [("user_id", "bigint"), ("event_type", "string"),
                                       ("value", "double"), ("k", "int")]).drop("ts")


@query("fun23_scale_by_constant", """SELECT vec_id, i::INTEGER AS dim, round(v / 255, 8) AS scaled FROM (SELECT vec_id,
  unnest(generate_series(0, 63)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)""")
def scale_const(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.posexplode(
        F.col("embedding").cast("array<double>")).alias("dim", "v")).select(
        "vec_id", "dim", F.round(F.col("v") / 255, 8).alias("scaled"))


@query("udf01_apply_scalar", """SELECT event_id, CASE WHEN value > 100 THEN round(ln(value), 6)
  ELSE 0 END AS squashed FROM events""")
def udf_one(spark, folder):
    def squash(v):
        import numpy as np
        return np.where(v > 100, np.log(v.where(v > 100, 1.0)), 0.0).round(6)

    def call(v):
        import pandas as pd
        return pd.Series(squash(v))
    return table(spark, folder, "events").select(
        "event_id", apply_vectorised(call, "double", "value").alias("squashed"))


@query("udf02_apply_columns", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_discount > 0.05 THEN l_quantity ELSE -l_quantity END AS signed FROM lineitem""")
def udf_two(spark, folder):
    def signed(q, d):
        return q.where(d > 0.05, -q)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        apply_vectorised(signed, "double", "l_quantity", "l_discount").alias("signed"))


@query("udf03_map_elements", """SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[],
  lambda x: x * x)), 5) AS norm2 FROM embeddings""")
def map_elements(spark, folder):
    v = F.col("embedding").cast("array<double>")
    squares = F.transform(v, lambda x: x * x)
    return table(spark, folder, "embeddings").select("vec_id", F.round(
        F.aggregate(squares, F.lit(0.0), lambda s, x: s + x), 5).alias("norm2"))
