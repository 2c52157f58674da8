"""SRC: scans, sinks and messages. Round trips go through the shared work folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tidegauge.operators.timeseries import date_range
from tidegauge.functions.hashing import sql_unit_hash
from tidegauge.queries import query
from tidegauge.queries.common import EVENT_SENTIMENT, SQL_EVENTS, labelled_events
from tidegauge.session import work_dir
from tidegauge.sources import artifacts, events as EV, html, tables as TB
from tidegauge.sources.tables import table


#: Texts that a file of the corpus holds at most, whatever a task or a language has.
TEXTS_PER_FILE = 1000


def scratch(spark, name):
    return os.path.join(work_dir(spark), f"{name}-{uuid.uuid4().hex}")


@query("src01_read_event_csv", f"""WITH {SQL_EVENTS}
SELECT event_id AS tweet_id, airline_sentiment, ts AS tweet_created, props AS text FROM ev""")
def read_event_csv(spark, folder):
    cols = {"tweet_created": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
            "tweet_id": F.col("event_id"), "airline_sentiment": F.col("airline_sentiment"),
            "text": F.col("props")}
    out = labelled_events(spark, folder).select(
        *[cols.get(n, F.lit(None)).cast("string" if n == "tweet_created" else t).alias(n)
          for n, t in EV.EVENT_COLUMNS])
    path = scratch(spark, "events-csv")
    TB.write_csv(out, path)
    return EV.read_events(spark, path).orderBy("tweet_created", "tweet_id").select(
        "tweet_id", "airline_sentiment", F.col("tweet_created").cast("timestamp_ntz")
        .alias("tweet_created"), "text")


@query("src02_offset_range", """SELECT event_id, ts FROM events
WHERE ts > TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12 12:00:00'""")
def offset_range(spark, folder):
    ev = table(spark, folder, "events").select("event_id", "ts")
    return EV.offset_range(ev, "ts", "2024-01-10 00:00:00", "2024-01-12 12:00:00")


@query("src03_add_data", """SELECT event_id, ts FROM events
UNION ALL SELECT event_id + 1000000000, ts + INTERVAL 30 DAY FROM events WHERE event_type = 'error'""")
def add_data(spark, folder):
    ev = table(spark, folder, "events")
    new = ev.where("event_type = 'error'").select(
        (F.col("event_id") + 1000000000).alias("event_id"),
        (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    return EV.add_data(ev.select("event_id", "ts"), new)


@query("src04_retime", """SELECT event_id, ts + (TIMESTAMP '2025-06-01 00:00:00' -
  (SELECT max(ts) FROM events)) AS ts FROM events""")
def retime(spark, folder):
    ev = table(spark, folder, "events").select("event_id", "ts")
    return EV.retime(ev, "ts", "2025-06-01 00:00:00")


@query("src05_high_water_mark", """SELECT floor(epoch(max(ts)))::BIGINT AS original,
  max(ts) AS original_datetime FROM events""")
def high_water(spark, folder):
    path = scratch(spark, "offset")
    EV.publish_high_water_mark(table(spark, folder, "events").select("ts"), "ts", path)
    return spark.read.parquet(path)


EVENT_DTYPES = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
                ("event_type", "string"), ("value", "double"), ("props", "string")]


@query("src06_data_schema", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null FROM events"
    for c, t in EVENT_DTYPES))
def data_schema(spark, folder):
    return TB.schema_report(table(spark, folder, "events"))


@query("src07_read_csv", "SELECT * FROM customer")
def read_csv(spark, folder):
    return TB.round_trip(table(spark, folder, "customer"), scratch(spark, "customer"), "csv")


@query("src08_read_series_csv", """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS ts,
  round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1""")
def read_series(spark, folder):
    monthly = table(spark, folder, "orders").groupBy(
        F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("DATE")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("TOTAL"))
    path = scratch(spark, "series")
    TB.write_csv(monthly, path)
    series = TB.read_series_csv(spark, path, "DATE", "TOTAL")
    return series.select(F.date_format("ts", "yyyy-MM-dd").alias("ts"), "y")


@query("src09_write_csv", "SELECT doc_id, text, lang FROM documents")
def write_csv(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return TB.round_trip(docs, scratch(spark, "documents"), "csv")


@query("src10_json_round_trip", "SELECT event_id, event_type, value, props FROM events")
def json_round_trip(spark, folder):
    ev = table(spark, folder, "events").select("event_id", "event_type", "value", "props")
    return TB.round_trip(ev, scratch(spark, "json"), "json")


@query("src10_parquet_round_trip", "SELECT * FROM orders")
def parquet_round_trip(spark, folder):
    return TB.round_trip(table(spark, folder, "orders"), scratch(spark, "parquet"), "parquet")


@query("src10_orc_round_trip", "SELECT * FROM supplier")
def orc_round_trip(spark, folder):
    return TB.round_trip(table(spark, folder, "supplier"), scratch(spark, "orc"), "orc")


SQL_REVENUE = """SELECT c.c_mktsegment, count(*) AS orders, round(sum(o.o_totalprice), 2) AS revenue
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment"""


@query("src10_read_sql", SQL_REVENUE.format(orders="orders", customer="customer"))
def read_sql(spark, folder):
    return TB.read_sql(spark, SQL_REVENUE, orders=table(spark, folder, "orders"),
                       customer=table(spark, folder, "customer"))


SQL_MARKUP = """t AS (SELECT page_id, unnest(generate_series(1, len(x))) - 1 AS table_no, unnest(x) AS t
  FROM (SELECT page_id, regexp_extract_all(html, '(?is)<{0}\\b[^>]*>(.*?)</{0}\\s*>', 1) AS x FROM pages)),
r AS (SELECT page_id, table_no, unnest(generate_series(1, len(x))) - 1 AS row_no, unnest(x) AS r
  FROM (SELECT page_id, table_no, regexp_extract_all(t, '(?is)<{1}\\b[^>]*>(.*?)</{1}\\s*>', 1) AS x FROM t)),
c AS (SELECT page_id, table_no, row_no, unnest(generate_series(1, len(x))) - 1 AS cell_no, unnest(x) AS c
  FROM (SELECT page_id, table_no, row_no,
    regexp_extract_all(r, '(?is)<(?:{2})\\b[^>]*>(.*?)</(?:{2})\\s*>', 1) AS x FROM r))
SELECT page_id, table_no::INTEGER AS table_no, row_no::INTEGER AS row_no, cell_no::INTEGER AS cell_no,
  trim(regexp_replace(regexp_replace(c, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS cell FROM c"""


@query("src11_html_tables", "WITH " + SQL_MARKUP.format("table", "tr", "td|th"))
def html_tables(spark, folder):
    return TB.html_tables(table(spark, folder, "pages"))


@query("src11_html_lists", "WITH " + SQL_MARKUP.format("ul", "li", "a"))
def html_lists(spark, folder):
    return TB.html_tables(table(spark, folder, "pages"), table_tag="ul", row_tag="li", cell_tag="a")


# Tables written into the pages: rows of cells from their numbers, one spanning two columns and one two
# rows, a nested table, a comment, entities, and end tags left out.
SQL_GRID = """WITH p AS (SELECT page_id, page_id % 7 AS n FROM pages WHERE html IS NOT NULL)
SELECT page_id, 0::INTEGER AS table_no, 0::INTEGER AS row_no, c::INTEGER AS cell_no, CASE WHEN c < 2 THEN 'a & b' ELSE 'h' || n END AS cell
FROM p, range(3) t(c)
UNION ALL SELECT page_id, 0, r::INTEGER + 1, 0, 'tall' FROM p, range(2) t(r)
UNION ALL SELECT page_id, 0, r::INTEGER + 1, c::INTEGER + 1, 'r' || r || 'c' || c || ' < ' || n FROM p, range(2) t(r), range(2) u(c)
UNION ALL SELECT page_id, 0, 3, 0, 'out' FROM p UNION ALL SELECT page_id, 1, 0, 0, 'in ' || n FROM p"""


@query("src11_html_grids", SQL_GRID)
def html_grids(spark, folder):
    """Spans, nested tables, comments, entities and open cells, in every page."""
    pages = table(spark, folder, "pages").where("html IS NOT NULL")
    n = (F.col("page_id") % 7).cast("string")
    cells = [F.concat(F.lit(f"<td>r{r}c{c} &lt; "), n) for r in range(2) for c in range(2)]
    markup = F.concat(F.lit("<!-- <table><tr><td>no</td></tr></table> --><TABLE><tr><th colspan='2'>a &amp;\n b</th><th>h"), n,
                      F.lit("<tr><td rowspan=2>tall"), cells[0], cells[1], F.lit("</tr><tr>"), cells[2], cells[3],
                      F.lit("<tr><td>out<table><tr><td>in "), n, F.lit("</td></tr></table></td></tr></table>"))
    return html.html_grids(pages.select("page_id", F.concat(markup, "html").alias("html"))).where("table_no < 2")


@query("src12_text_corpus", """SELECT lang, count(*) AS texts, sum(length(text))::BIGINT AS chars
FROM documents GROUP BY 1""")
def text_corpus(spark, folder):
    path = scratch(spark, "corpus")
    docs = table(spark, folder, "documents").select("lang", "text")
    # files of a bounded number of texts, one JSON-escaped text per line; each file is read as a whole
    docs.select("lang", F.to_json(F.struct("text")).alias("value")).write.partitionBy("lang").option(
        "maxRecordsPerFile", TEXTS_PER_FILE).text(path)
    files = TB.read_text_corpus(spark, path)
    lines = files.select(F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang"), F.explode(
        F.split("text", "\n")).alias("_line")).where("_line != ''")
    texts = lines.select("lang", F.from_json("_line", "text string").alias("_t"))
    return texts.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"),
                                     F.sum(F.length("_t.text")).alias("chars"))


@query("src13_labelled_files", """SELECT o_orderpriority AS label, count(*) AS rows FROM orders GROUP BY 1""")
def labelled_files(spark, folder):
    """Files in one folder per label; each label's rows are counted from its files."""
    path = scratch(spark, "labelled")
    o = table(spark, folder, "orders").select(
        F.regexp_replace("o_orderpriority", " ", "_").alias("label"), "o_orderkey")
    o.write.partitionBy("label").csv(path)
    found = TB.read_labelled_files(spark, path, "*.csv").select(
        F.regexp_extract("label", "label=(.*)", 1).alias("label")).distinct()
    rows = spark.read.csv(path).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    return found.join(rows, "label").select(
        F.regexp_replace("label", "_", " ").alias("label"), "rows")


@query("src14_artifact", f"""WITH {SQL_EVENTS} SELECT sentiment, count(*) AS cnt FROM ev GROUP BY 1""")
def artifact(spark, folder):
    root = scratch(spark, "artifacts")
    counts = labelled_events(spark, folder).groupBy("sentiment").agg(F.count(F.lit(1)).alias("cnt"))
    artifacts.save_artifact(counts, root, "sentiment_counts")
    return artifacts.load_artifact(spark, root, "sentiment_counts")


@query("src14_artifact_replaced_by_itself", f"""WITH {SQL_EVENTS},
c AS (SELECT sentiment, event_type, count(*) AS cnt FROM ev GROUP BY 1, 2)
SELECT 'first' AS version, sentiment, event_type, cnt FROM c
UNION ALL SELECT 'second', sentiment, event_type, cnt FROM c WHERE sentiment != 0
UNION ALL SELECT 'third', sentiment, event_type, cnt FROM c""")
def artifact_replaced(spark, folder):
    """A version made from the one it replaces, one appended to, and readers pinned to either."""
    root, name = scratch(spark, "artifacts"), "counts"
    counts = labelled_events(spark, folder).groupBy("sentiment", "event_type").agg(F.count(F.lit(1)).alias("cnt"))
    versions = [artifacts.save_artifact(counts, root, name)]
    first = artifacts.load_artifact(spark, root, name)
    versions.append(artifacts.save_artifact(first.where("sentiment != 0"), root, name, expect=versions[0]))
    versions.append(artifacts.append_artifact(first.where("sentiment = 0"), root, name))
    found = [artifacts.load_artifact(spark, root, name, version=v).withColumn("version", F.lit(label))
             for v, label in zip(versions, ("first", "second", "third"))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("src15_log_metric", """SELECT 'run-1' AS run_id, 'rows' AS name, count(*)::DOUBLE AS value FROM events
UNION ALL SELECT 'run-1', 'mean', round(avg(value), 6) FROM events""")
def metrics(spark, folder):
    root = scratch(spark, "metrics")
    row = table(spark, folder, "events").agg(F.count(F.lit(1)).alias("rows"),
                                             F.round(F.avg("value"), 6).alias("mean")).first()
    artifacts.log_metrics(spark, root, "run-1", row.asDict(), "2024-02-01 00:00:00")
    return artifacts.load_artifact(spark, root, "metrics").select("run_id", "name", "value")


@query("src16_to_message", """SELECT event_id, '["' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '+0000",' ||
  user_id || ',"' || event_type || '",' || CASE WHEN event_type = 'error' THEN 'null'
  ELSE json_extract_string(props, '$.k') END || ']' AS body FROM events""")
def to_message(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int")
    ev = table(spark, folder, "events").withColumn("k", F.when(F.col("event_type") != "error", k))
    return ev.select("event_id", EV.to_message(ev, "ts", ["user_id", "event_type", "k"]).alias("body"))


@query("src17_from_message", f"""WITH {SQL_EVENTS}
SELECT date_trunc('second', ts)::TIMESTAMP AS ts, event_id AS tweet_id, airline_sentiment, value,
  sentiment FROM ev""")
def from_message(spark, folder):
    ev = labelled_events(spark, folder).withColumnRenamed("event_id", "tweet_id")
    body = ev.select(EV.to_message(ev, "ts", ["tweet_id", "airline_sentiment", "value"]).alias("body"))
    out = EV.from_message(body, "body", [("tweet_id", "bigint"), ("airline_sentiment", "string"),
                                         ("value", "double")], "airline_sentiment")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("src17_from_epoch_message", f"""WITH {SQL_EVENTS}
SELECT date_trunc('second', ts)::TIMESTAMP AS ts, event_id AS tweet_id, sentiment FROM ev""")
def from_epoch_message(spark, folder):
    ev = labelled_events(spark, folder)
    body = ev.select(F.concat(
        F.lit("["), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit(","),
        F.col("event_id").cast("string"), F.lit(',"'), "airline_sentiment", F.lit('"]')).alias("body"))
    out = EV.from_message(body, "body", [("tweet_id", "bigint"), ("airline_sentiment", "string")],
                          "airline_sentiment")
    return out.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "tweet_id", "sentiment")


@query("src18_dictionary_lookup", """SELECT column_name, non_null FROM (
  SELECT 'o_totalprice' AS column_name, count(o_totalprice) AS non_null FROM orders)""")
def dictionary_lookup(spark, folder):
    report = TB.schema_report(table(spark, folder, "orders"))
    return TB.lookup(report, "column_name", "non_null", "o_totalprice")


@query("src19_dummy_model_data", f"""WITH n AS (SELECT count(*) AS n, max(ts) AS last FROM events)
SELECT round(i * 8 * pi() / greatest(n - 1, 1), 6) AS x, floor({sql_unit_hash('i', seed=7)} * 3)::INTEGER AS target,
  last + i * INTERVAL 1 MINUTE AS ts FROM n, (SELECT unnest(generate_series(0, (SELECT count(*) FROM events) - 1)) AS i)""")
def dummy_data(spark, folder):
    """As many synthetic rows as there are events, at one-minute steps after the newest event."""
    ev = table(spark, folder, "events").select("ts")
    return TB.dummy_model_data(ev, "ts", 3, seed=7).withColumn("x", F.round("x", 6))


@query("src19_dummy_model_times", """WITH n AS (SELECT count(*) AS n, max(ts) AS last FROM events)
SELECT round(i * 8 * pi() / greatest(n - 1, 1), 6) AS x, last + i * INTERVAL 1 MINUTE AS ts
FROM n, (SELECT unnest(generate_series(0, (SELECT count(*) FROM events) - 1)) AS i)""")
def dummy_times(spark, folder):
    ev = table(spark, folder, "events").select("ts")
    return TB.dummy_model_data(ev, "ts", 3, seed=7).select(F.round("x", 6).alias("x"), "ts")


@query("src20_inline_table", """SELECT e.event_id, m.label FROM events e JOIN (VALUES
  ('purchase', 'positive'), ('signup', 'positive'), ('view', 'neutral'), ('click', 'neutral'),
  ('error', 'negative')) AS m(event_type, label) ON m.event_type = e.event_type""")
def inline(spark, folder):
    mapping = TB.inline_table(spark, list(EVENT_SENTIMENT.items()), "event_type string, label string")
    # a five-row literal
    return table(spark, folder, "events").join(F.broadcast(mapping), "event_type").select(
        "event_id", "label")
