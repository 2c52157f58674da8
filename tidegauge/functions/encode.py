"""Categorical encodings and random columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.hashing import unit_hash

def dummies(df: DataFrame, column: str, levels: list, drop_first: bool = False) -> DataFrame:
    """0/1 column ``<column>_<level>`` per level; the source column is dropped.

    The levels are part of the schema, so the caller names them; ``one_hot_long`` takes any.
    """
    kept = levels[1:] if drop_first else levels
    cols = [F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}")
            for v in kept]
    return df.select(*[c for c in df.columns if c != column], *cols)


def one_hot_long(df: DataFrame, key: str, column: str) -> DataFrame:
    """Sparse form for any number of levels: one row per set cell."""
    return df.where(F.col(column).isNotNull()).select(
        key, F.col(column).alias("level"), F.lit(1).alias("value"))


def binarise(column: str, levels: list) -> Column:
    """Array with 1 at the position of the value in the sorted level list, else 0."""
    return F.array(*[(F.col(column) == v).cast("int") for v in sorted(levels)])


def random_columns(df: DataFrame, ids: list[str], seed: int, low: int = 0, high: int = 100) -> DataFrame:
    """Uniform, normal and integer columns that follow from the ids and the seed."""
    u = [unit_hash(*ids, seed=seed + k) for k in range(4)]
    # Box-Muller: 1 - u is never 0
    normal = F.sqrt(-2.0 * F.log(1.0 - u[1])) * F.cos(2.0 * F.pi() * u[2])
    return (df.withColumn("uniform", u[0]).withColumn("normal", normal)
            .withColumn("integer", (F.floor(u[3] * (high - low)) + low).cast("int")))
