"""Grouped and whole-table aggregation beyond a plain ``groupBy().agg``."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidegauge.functions.hashing import unit_hash
from tidegauge.operators.joins import null_safe_join

from tidegauge.operators.timeseries import fill_gaps


def _descending(value: Column, kind: T.DataType) -> Column | None:
    """Something that sorts the other way round, none where the type has nothing that cannot overflow."""
    if isinstance(kind, T.IntegralType):
        return F.bitwise_not(value)
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return -value
    if isinstance(kind, T.DateType):
        return -F.unix_date(value)
    if isinstance(kind, T.TimestampType):
        return F.bitwise_not(F.unix_micros(value))
    return None


def extreme_keys(df: DataFrame, value: str, key: str, keys: list[str] = ()) -> DataFrame:
    """``idxmin`` / ``idxmax``: key of the extreme value, the smallest key on ties.

    Null and NaN values are missing and count for neither; a group without any other has null keys.
    ``key`` and ``value`` may be of any type that can be ordered. Types that cannot be turned round
    without overflow (strings) take a second pass over the rows, for the keys of the largest value.
    """
    kind, v = df.schema[value].dataType, F.col(value)
    there = v.isNotNull() & ~F.isnan(v) if isinstance(kind, (T.DoubleType, T.FloatType)) else v.isNotNull()
    least = F.min_by(key, F.when(there, F.struct(v, F.col(key)))).alias("idxmin")
    turned = _descending(v, kind)
    if turned is not None:
        return df.groupBy(*keys).agg(least, F.min_by(key, F.when(there, F.struct(turned, F.col(key)))).alias("idxmax"))
    found = df.groupBy(*keys).agg(least, F.max(v).alias("_most"))
    rows = df.select(*keys, F.col(key).alias("_key"), v.alias("_value"))
    if keys:
        rows = null_safe_join(rows, found, list(keys))
    else:  # two values, looked up in every row
        rows = rows.withColumns({c: found.select(c).scalar() for c in ("idxmin", "_most")})
    return rows.groupBy(*keys).agg(F.first("idxmin").alias("idxmin"), F.min(F.when(
        F.col("_value") == F.col("_most"), F.col("_key"))).alias("idxmax"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, most frequent first; nulls are not counted."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.col("cnt").desc(), column))


def mode(df: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """Most frequent non-null value, the smallest on ties.

    Values are counted first, so the second step sees one row per distinct value.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(
        F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias("mode"))


def mean_absolute_deviation(df: DataFrame, column: str, keys: list[str] = ()) -> DataFrame:
    """mean(|x - mean|): the mean is a first, tiny aggregate that the second pass looks up."""
    if not keys:
        mean = df.agg(F.avg(column)).scalar()
        return df.select(column).withColumn("_mean", mean).agg(
            F.avg(F.abs(F.col(column) - F.col("_mean"))).alias("mad"))
    means = df.groupBy(*keys).agg(F.avg(column).alias("_mean"))
    return null_safe_join(df, means, list(keys)).groupBy(*keys).agg(
        F.avg(F.abs(F.col(column) - F.col("_mean"))).alias("mad"))


def moments(column: str) -> dict[str, Column]:
    """Sample and population moments with the usual small-sample corrections.

    Spark's ``skewness`` and ``kurtosis`` are population values; ``skew`` and ``kurt`` are the
    unbiased G1 and excess G2.
    """
    x = F.col(column)
    n = F.count(x).cast("double")
    skew = F.skewness(x) * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0))
    kurt = (((n + 1.0) * F.kurtosis(x) + 6.0) * (n - 1.0)
            / F.nullif((n - 2.0) * (n - 3.0), F.lit(0.0)))
    return {
        "std": F.stddev_samp(x), "var": F.var_samp(x),
        "std_pop": F.stddev_pop(x), "var_pop": F.var_pop(x),
        "sem": F.stddev_samp(x) / F.sqrt(n), "skew": skew, "kurt": kurt,
    }


def daily_class_pivot(df: DataFrame, ts: str, label: str, classes: list[str]) -> DataFrame:
    """Counts per day and class with a row total.

    Each class is 0 inside its own first..last day and null outside; the total ignores nulls.
    """
    daily = df.groupBy(label, F.window(ts, "1 day").alias("_w")).agg(
        F.count(F.lit(1)).alias("cnt")).select(label, F.col("_w.start").alias("ts_bin"), "cnt")
    filled = fill_gaps(daily, [label], "1 day")
    wide = filled.groupBy(F.col("ts_bin").alias("day")).pivot(label, classes).agg(F.sum("cnt"))
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in classes[1:]),
                F.coalesce(F.col(classes[0]), F.lit(0)))
    return wide.withColumn("total", total)


def row_sum(columns: list[str]) -> Column:
    """Sum across columns, nulls skipped."""
    first, *rest = [F.coalesce(F.col(c), F.lit(0)) for c in columns]
    return sum(rest, first)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation ``(a, b, corr)`` of every ordered pair, from one aggregation.

    Each pair uses the rows where both columns are present.
    """
    pairs = list(combinations_with_replacement(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{i}").alias("corr"))
             for i, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])]
    return one.select(F.inline(F.array(*cells)))


def correlation_with(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Correlation of each column with the target, ascending; the target itself is left out."""
    others = [c for c in columns if c != target]
    one = df.agg(*[F.corr(c, target).alias(c) for c in others])
    return one.unpivot([], others, "column_name", "corr").orderBy("corr", "column_name")


def conditional_ratio(df: DataFrame, key: str, top: Column, bottom: Column,
                      out: str = "ratio") -> DataFrame:
    """Rows matching ``top`` per row matching ``bottom`` in each group; null when either is absent."""
    a, b = F.count_if(top), F.count_if(bottom)
    return df.groupBy(key).agg(F.when((a > 0) & (b > 0), a / F.nullif(b, F.lit(0))).alias(out))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``bins`` equal-width bins over [min, max], the last one closed; empty bins are listed."""
    x = F.col(column).cast("double")
    span = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    width = (F.col("_s.hi") - F.col("_s.lo")) / F.lit(float(bins))
    at = F.when(F.col("_s.hi") == F.col("_s.lo"), F.lit(0)).otherwise(
        F.least(F.floor((x - F.col("_s.lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    counts = (df.where(x.isNotNull()).withColumn("_s", span).groupBy(at.cast("int").alias("bin"))
              .agg(F.count(F.lit(1)).alias("cnt")))
    frame = (df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
             .withColumn("_s", span))
    return (frame.join(counts, "bin", "left")
            .select("bin", (F.col("_s.lo") + F.col("bin") * width).alias("lower"),
                    (F.col("_s.lo") + (F.col("bin") + 1) * width).alias("upper"),
                    F.coalesce("cnt", F.lit(0)).alias("cnt")))


def time_bounds(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def sample_rows(df: DataFrame, ids: list[str], share: float, seed: int = 0) -> DataFrame:
    """Reproducible share of the rows, chosen by a seeded id hash.

    ``DataFrame.sample`` draws per partition, so its rows change with the file layout.
    """
    return df.where(unit_hash(*ids, seed=seed) < share)


def sample_points(df: DataFrame, x: str, y: str, ids: list[str], share: float,
                  seed: int = 0) -> DataFrame:
    """Reproducible share of the (x, y) points of a scatter plot."""
    return sample_rows(df, ids, share, seed).select(*ids, x, y)
