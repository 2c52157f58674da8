"""Table scans with declared schemas, text corpora and format round trips."""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidegauge.functions.hashing import unit_hash


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet scan of one named table in ``folder``."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Typed CSV scan with header. The schema is declared, so there is no inference pass."""
    return (
        spark.read.schema(schema)
        .option("header", True).option("multiLine", True).option("escape", '"')
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def read_series_csv(spark: SparkSession, path: str, date_col: str, value_col: str) -> DataFrame:
    """One dated value per row, parsed to ``(ts DATE, y DOUBLE)``; an unparsable date is null."""
    schema = T.StructType([T.StructField(date_col, T.StringType()),
                           T.StructField(value_col, T.DoubleType())])
    raw = read_csv(spark, path, schema)
    return raw.select(F.try_to_timestamp(F.col(date_col)).cast("date").alias("ts"),
                      F.col(value_col).alias("y"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def round_trip(df: DataFrame, path: str, fmt: str) -> DataFrame:
    """Write ``df`` in a Spark format and read it back with its own schema."""
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        write_csv(df, path)
        return read_csv(df.sparkSession, path, df.schema)
    writer.format(fmt).save(path)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


def read_sql(spark: SparkSession, statement: str, **tables: DataFrame) -> DataFrame:
    """Result of a SQL statement that names its tables as ``{name}``."""
    return spark.sql(statement, **tables)


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per file holding its whole text."""
    return (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def read_labelled_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files whose label is the name of their parent folder; content is never read here."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern).load(path)
        .select("path", "length", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label"))
    )


def lookup(dictionary: DataFrame, key_col: str, value_col: str, key: str) -> DataFrame:
    """Description stored under one key."""
    return dictionary.where(F.col(key_col) == key).select(key_col, value_col)


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table with an explicit schema."""
    return spark.createDataFrame(rows, schema)


def html_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                table_tag: str = "table", row_tag: str = "tr", cell_tag: str = "td|th") -> DataFrame:
    """Every cell of every table row: ``(id, table_no, row_no, cell_no, cell)``, zero-based.

    Markup is matched case-insensitively over the whole page; tags inside a cell are removed and
    whitespace is collapsed. Other tag names read lists the same way.
    """
    def inside(text: str, tag: str) -> Column:
        pattern = rf"(?is)<(?:{tag})\b[^>]*>(.*?)</(?:{tag})\s*>"
        return F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))

    tables = pages.select(id_col, inside(html_col, table_tag).alias("table_no", "_t"))
    rows = tables.select(id_col, "table_no", inside("_t", row_tag).alias("row_no", "_r"))
    cells = rows.select(id_col, "table_no", "row_no", inside("_r", cell_tag).alias("cell_no", "_c"))
    text = F.regexp_replace(F.regexp_replace("_c", r"<[^>]*>", ""), r"\s+", " ")
    return cells.select(id_col, "table_no", "row_no", "cell_no", F.trim(text).alias("cell"))


def dummy_model_data(like: DataFrame, ts: str, classes: int, seed: int) -> DataFrame:
    """Synthetic ``(x, target, ts)``: one row per row of ``like``.

    x runs evenly over [0, 8 pi], the target is a random class, time advances by one minute from
    the newest instant of ``like``.
    """
    facts = like.agg(F.struct(F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))).scalar()
    size = like.count()
    return (like.sparkSession.range(size).withColumn("_f", facts).select(
        (F.col("id") * F.lit(8 * math.pi) / F.greatest(F.col("_f.n") - 1, F.lit(1))).alias("x"),
        F.floor(unit_hash("id", seed=seed) * classes).cast("int").alias("target"),
        (F.col("_f.last") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts")))


def schema_report(df: DataFrame) -> DataFrame:
    """Column name, type and non-null count, one pass over the table."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    return (counts.unpivot([], df.columns, "column_name", "non_null")
            .select("column_name", types[F.col("column_name")].alias("dtype"), "non_null"))
