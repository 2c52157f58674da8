"""Projection, filtering and reshaping helpers that need more than one Spark call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def mask_cells(df: DataFrame, columns: list[str], keep) -> DataFrame:
    """Keep a cell where ``keep(column)`` holds, else null."""
    return df.withColumns({c: F.when(keep(F.col(c)), F.col(c)) for c in columns})


def select_labels(df: DataFrame, key: str, labels: list, columns: list[str] | None = None,
                  drop: bool = False) -> DataFrame:
    """Rows with (or, with ``drop``, without) the given keys, optionally only some columns."""
    hit = F.col(key).isin(labels)
    rows = df.where(~hit) if drop else df.where(hit)
    return rows.select(key, *columns) if columns else rows


def date_slice(df: DataFrame, ts: str, start: str | None = None,
               stop: str | None = None) -> DataFrame:
    """Inclusive at both ends, each end optional; plain comparisons, so Parquet can skip groups."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if stop is not None:
        df = df.where(F.col(ts) <= F.lit(stop).cast("timestamp_ntz"))
    return df


def split_at(df: DataFrame, ts: str, instant: Column) -> tuple[DataFrame, DataFrame]:
    """Rows at or before the instant, and rows after it."""
    return df.where(F.col(ts) <= instant), df.where(F.col(ts) > instant)


def columns_of_type(df: DataFrame, dtype: str) -> DataFrame:
    return df.select(*[f.name for f in df.schema if f.dataType.simpleString() == dtype])


def transpose_long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows become ``(column_name, key, value)``, the shape that scales past a few thousand keys."""
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [key], columns, "column_name", "value")


def transpose(df: DataFrame, key: str, columns: list[str], key_values: list) -> DataFrame:
    """Rows become columns for a known, short list of keys; one shuffle on the column name."""
    long = transpose_long(df, key, columns)
    return long.groupBy("column_name").pivot(key, key_values).agg(F.first("value"))
