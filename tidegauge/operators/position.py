"""Row positions over whole tables without a single-task sort.

An un-partitioned ``row_number`` sorts every row in one task. Here Spark range-partitions the rows,
each partition numbers its own rows, and the partition sizes (one row per partition) turn local
numbers into global ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.operators.joins import null_safe_join
from tidegauge.session import spool


def with_position(df: DataFrame, order: list, name: str = "pos", keys: list[str] = ()) -> DataFrame:
    """Zero-based position of each row in ``order``, within ``keys`` when given.

    ``order`` must end in a unique column, so that the numbering is defined and a hot value is
    spread over several ranges. Keys may be as uneven as they like: ranges cut across them.
    """
    keys = list(keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    local = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    ranged = spool(
        df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
        .withColumn("_part", F.spark_partition_id()).withColumn("_local", local)
    )
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
               .select("_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_offset")))
    # one row per shuffle partition, so the broadcast does not grow with the data
    numbered = (ranged.join(F.broadcast(offsets), "_part")
                .withColumn(name, F.col("_offset") + F.col("_local"))
                .drop("_part", "_local", "_offset"))
    if not keys:
        return numbered
    first = numbered.groupBy(*keys).agg(F.min(name).alias("_first"))
    return (null_safe_join(numbered, first, keys)
            .withColumn(name, F.col(name) - F.col("_first")).drop("_first"))


def _bound(value: int) -> Column:
    return F.lit(value) if value >= 0 else F.greatest(F.lit(0), F.col("_size") + F.lit(value))


def _edges(df: DataFrame, order: list, **at: Column) -> Column:
    """Struct with the order key of the row at each position of ``at`` (over ``_size``, the number of
    rows); null beyond the end. Only the order columns are put in order."""
    names = [c for c in order if isinstance(c, str)] or df.columns
    numbered = with_position(df.select(*names), order, "_pos").withColumn(
        "_size", df.agg(F.count(F.lit(1))).scalar())
    # struct comparison puts nulls first, as sorting does
    key = F.struct(*names)
    return numbered.agg(F.struct(*(F.min(F.when(F.col("_pos") == p, key)).alias(n) for n, p in at.items()))).scalar()


def slice_rows(df: DataFrame, order: list[str], start: int | None = None,
               stop: int | None = None) -> DataFrame:
    """Positional slice ``[start:stop]`` in ``order``; negative bounds count from the end.

    The rows at the bounds are found by position, the slice is a filter on the scan. ``order`` names
    ascending columns, nulls first, and ends in a unique one.
    """
    cuts = {n: _bound(v) for n, v in (("start", start), ("stop", stop)) if v is not None}
    if not cuts:
        return df
    cut = df.withColumn("_cut", _edges(df, order, **cuts))
    key = F.struct(*order)
    if start is not None:
        cut = cut.where(key >= F.col("_cut.start"))
    if stop is not None:
        cut = cut.where(F.coalesce(key < F.col("_cut.stop"), F.lit(True)))
    return cut.drop("_cut")


def filter_data(df: DataFrame, order: list[str], head: bool = True,
                num_rows_head: int | None = None, num_rows_tail: int | None = None) -> DataFrame:
    """First/last rows, or everything but them.

    ``head`` with ``num_rows_head`` keeps the first n, with ``num_rows_tail`` all but the last n;
    not ``head`` keeps all after the first n, or the last n. Exactly one size must be given.
    ``order`` holds ascending columns, nulls first, and ends in a unique one.
    """
    if (num_rows_head is None) == (num_rows_tail is None):
        raise ValueError("give exactly one of num_rows_head and num_rows_tail")
    n = num_rows_head if num_rows_head is not None else num_rows_tail
    if n < 0:
        raise ValueError("the number of rows must not be negative")
    from_start = num_rows_head is not None
    if n == 0:
        return df.where(F.lit(head != from_start))
    cut = n if from_start else -n
    return slice_rows(df, order, None, cut) if head else slice_rows(df, order, cut)


def reset_index(df: DataFrame, order: list, name: str = "index") -> DataFrame:
    """Number the rows 0..n-1 in ``order``."""
    return with_position(df, order, name)


def _tagged(df: DataFrame, order: list[str], at: Column, name: str) -> DataFrame:
    """``train`` before the row at a position, ``test`` from it on."""
    cut = df.withColumn("_cut", _edges(df, order, at=at))
    before = F.coalesce(F.struct(*order) < F.col("_cut.at"), F.lit(True))
    return cut.withColumn(name, F.when(before, "train").otherwise("test")).drop("_cut")


def split_by_share(df: DataFrame, order: list[str], share: float, name: str = "part") -> DataFrame:
    """Tag the first ``int(share * n)`` rows ``train`` and the rest ``test``."""
    return _tagged(df, order, F.floor(F.lit(share) * F.col("_size")), name)


def split_last(df: DataFrame, order: list[str], test_rows: int, name: str = "part") -> DataFrame:
    """Tag the last ``test_rows`` rows ``test`` and all before them ``train``."""
    return _tagged(df, order, F.greatest(F.lit(0), F.col("_size") - F.lit(test_rows)), name)


def skip_top_share(df: DataFrame, value: str, tie: str, share: float = 0.01) -> DataFrame:
    """Drop the ``floor(share * n)`` rows with the largest values; nulls count as the smallest."""
    pairs = df.select(F.col(value).alias("_v"), F.col(tie).alias("_t"))
    edge = _edges(pairs, [F.col("_v").desc(), F.col("_t")], at=F.floor(F.lit(share) * F.col("_size")))
    cut = df.withColumn("_cut", edge)
    v, last = F.col(value), F.col("_cut.at._v")
    below = (v < last) | v.isNull() & last.isNotNull()
    kept = F.coalesce(below, F.lit(False)) | v.eqNullSafe(last) & (F.col(tie) >= F.col("_cut.at._t"))
    return cut.where(kept).drop("_cut")
