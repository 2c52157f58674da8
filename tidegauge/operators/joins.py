"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str],
                   how: str = "inner") -> DataFrame:
    """Join in which a null key matches a null key; the keys of the left side are kept."""
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])
