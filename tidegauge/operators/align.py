"""Index alignment as explicit keyed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegauge.operators.position import with_position


def aligned(left: DataFrame, right: DataFrame, keys: list[str], left_value: str, right_value: str,
            op, out: str, fill: float | None = None) -> DataFrame:
    """Outer join on the keys, then ``op``; a missing side is null, or ``fill`` when given."""
    a = left.select(*keys, F.col(left_value).alias("_a"))
    b = right.select(*keys, F.col(right_value).alias("_b"))
    x, y = F.col("_a"), F.col("_b")
    if fill is not None:
        x, y = F.coalesce(x, F.lit(fill)), F.coalesce(y, F.lit(fill))
    return a.join(b, keys, "full_outer").select(*keys, op(x, y).alias(out))


def assign(left: DataFrame, right: DataFrame, keys: list[str], value: str, out: str,
           fill: float = 0.0) -> DataFrame:
    """Attach a column by key; rows without a partner get ``fill``."""
    return (left.join(right.select(*keys, F.col(value).alias(out)), keys, "left")
            .withColumn(out, F.coalesce(out, F.lit(fill))))


def reindex(series: DataFrame, target: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Conform a series to another index; new index entries are null."""
    return target.select(*keys).join(series.select(*keys, value), keys, "left")


def concat_columns(left: DataFrame, right: DataFrame, left_order: list,
                   right_order: list) -> DataFrame:
    """Pair row n of one table with row n of the other; the shorter side is padded with null."""
    a = with_position(left, left_order, "row_no")
    b = with_position(right, right_order, "row_no")
    return a.join(b, "row_no", "full_outer")


def lookup_join(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Left join to an aggregated table; its measured size decides whether it is broadcast."""
    return df.join(mapping, key, "left")
