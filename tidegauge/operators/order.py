"""Sorting, top-k and appending. Limits are Spark's bounded top-k, never a full sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Last ``n`` rows of the ordering."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def first_match(df: DataFrame, condition: Column, order: list[str]) -> DataFrame:
    return df.where(condition).orderBy(*order).limit(1)


def category_order(df: DataFrame, column: str, categories: list[str],
                   rank: str = "rank") -> DataFrame:
    """Rank rows by a given category list; unknown categories get rank 0."""
    known = F.array(*[F.lit(c) for c in categories])
    return df.withColumn(rank, F.array_position(known, F.col(column))).orderBy(rank)


def shuffle_rows(df: DataFrame, ids: list[str], seed: int) -> DataFrame:
    """Reproducible random order: rows sorted by a seeded hash of their id."""
    return df.orderBy(F.xxhash64(*ids, F.lit(seed)), *ids)


def keep_last(history: DataFrame, new: DataFrame, order: list[str], n: int) -> DataFrame:
    """Append rows and keep the last ``n``."""
    return tail(history.unionByName(new), order, n)
