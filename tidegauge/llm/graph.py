"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegauge.session import spool


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every end of ``edges`` (``a, b``): ``label`` is the smallest node of its
    component.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest
    neighbour; the number of edges never grows and rounds are about the logarithm of the longest
    path. Rounds are written to the shared folder; the driver sees one row per round.
    """
    edges = spool(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct())
    before = _digest(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .distinct())
        large = spool(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = (small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
                 .union(least.select("a", F.col("m").alias("b"))).distinct())
        edges = spool(small)
        after = _digest(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
