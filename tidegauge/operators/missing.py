"""Missing data: counting, dropping and filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def null_counts(df: DataFrame) -> DataFrame:
    """``(column_name, nulls, null_pct)`` in one pass over the table."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return (one.unpivot(["_rows"], df.columns, "column_name", "nulls")
            .select("column_name", "nulls",
                    F.try_divide(100.0 * F.col("nulls"), F.col("_rows")).alias("null_pct")))


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Keep only columns without nulls. The schema of the result needs one small aggregate now."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if row[c] == 0])


def fill_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null cells take their column's mean, read once as a scalar subquery."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col("_means")[c]) for c in columns}
    return df.withColumn("_means", means).withColumns(filled).drop("_means")


def fill_group_mean(df: DataFrame, column: str, key: str) -> DataFrame:
    """Null cells take the mean of their group; a group without values stays null.

    The means are one row per group; Spark broadcasts them only when their size allows it.
    """
    means = df.groupBy(key).agg(F.avg(column).alias("_mean"))
    return (df.join(means, key, "left")
            .withColumn(column, F.coalesce(F.col(column).cast("double"), F.col("_mean")))
            .drop("_mean"))


def parse_time(column, fmt: str | None = None):
    """Timestamp, or null when the text is not one."""
    return F.try_to_timestamp(F.col(column), *([F.lit(fmt)] if fmt else []))
