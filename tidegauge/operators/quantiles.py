"""Exact quantiles (linear interpolation) whose group sizes are not bounded by one task.

The built-in ``percentile`` keeps every distinct value of a group in one buffer, which is fine for
binned series and fatal for raw columns. Here a first pass brackets each wanted rank with an
approximate sketch. A second one counts the rows between the brackets, and the values inside them one
by one, both combined where they are read; only the latter, some ten thousandth of a large group's
rows, are ever moved and ordered. The sketch only decides what is looked at; the result is exact.

What the rows of a group look up (its sketch, its quartiles) is written once to the shared folder, a row
per group. So Spark knows its size before it plans the second pass and brings it to the rows, not the
rows to it; only groups too many for that are joined by an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.operators.joins import null_safe_join
from tidegauge.session import spool

SLICES = 128
#: Accuracy of the sketch, and how far around a rank its brackets reach, in shares of a group: the
#: narrow ones serve groups of at least ``LARGE`` rows, the wide ones of at least ``SMALL``; below, all
#: values are looked at. Each is wide enough for the sketch's error and two ranks beyond.
ACCURACY = 100_000
NARROW, WIDE = 8 / ACCURACY, 0.01
LARGE, SMALL = ACCURACY // 4, 200


def _marks(qs: list[float]) -> list[float]:
    return [min(1.0, max(0.0, q + m)) for q in qs for m in (-WIDE, -NARROW, NARROW, WIDE)]


def sketch(v: Column, qs: list[float]) -> Column:
    """What the first pass keeps of a column: its count and the sketch's values around each quantile."""
    return F.struct(F.count(v).alias("total"), F.percentile_approx(v, _marks(qs), ACCURACY).alias("at"))


def _kept(facts: DataFrame, keys: list[str]) -> DataFrame:
    """A row per group, written so that its size is known; without keys there is one row, looked up as scalars.

    A sketch ``_f`` becomes one array: its count, then its values.
    """
    if "_f" in facts.columns:
        facts = facts.withColumn("_f", F.concat(F.array(F.col("_f.total").cast("double")), F.coalesce(
            "_f.at", F.array().cast("array<double>"))))
    return spool(facts) if keys else facts


def _brackets(facts: str, qs: list[float]) -> list[tuple[Column, Column]]:
    """Lowest and highest value that the ranks of each quantile can have; null: no limit."""
    total = F.get(facts, F.lit(0))

    def edge(i: int, narrow: int, wide: int) -> Column:
        return F.when(total >= LARGE, F.get(facts, F.lit(1 + 4 * i + narrow))).when(
            total >= SMALL, F.get(facts, F.lit(1 + 4 * i + wide)))
    return [(edge(i, 1, 0), edge(i, 2, 3)) for i in range(len(qs))]


def _looked_up(df: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the row of ``facts`` that belongs to each row's keys; without keys there is one."""
    if keys:
        return null_safe_join(df, facts, keys)
    return df.withColumns({c: facts.select(c).scalar() for c in facts.columns})


def ranked(df: DataFrame, value: str, facts: DataFrame, qs: list[float], keys: list[str]) -> DataFrame:
    """``(keys..., q, value)`` from the rows and the kept facts ``(keys..., _f)``; ``qs`` ascending."""
    v = F.col(value).cast("double")
    rows = _looked_up(df.where(F.col(value).isNotNull()).select(*keys, v.alias("_v")), facts.select(*keys, "_f"), keys)
    # the edges as columns of their own: each row is compared with two numbers per quantile
    edges = {f"_{n}{i}": c for i, pair in enumerate(_brackets("_f", qs)) for n, c in zip(("lo", "hi"), pair)}
    rows = rows.select(*keys, "_v", F.get("_f", F.lit(0)).cast("long").alias("_total"), *(c.alias(n) for n, c in edges.items()))
    inside, passed = F.lit(False), F.lit(0)
    for i in range(len(qs)):
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        inside = inside | (low.isNull() | ((F.col("_v") >= low) & (F.col("_v") <= high)))
        passed = passed + F.when(F.col("_v") > high, 1).otherwise(0)
    # rows between brackets are one row per gap, before the values of the bracket that follows
    counted = rows.groupBy(*keys, passed.alias("_gap"), F.when(inside, F.col("_v")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_total").alias("_total"))
    order = Window.partitionBy(*keys).orderBy("_gap", F.col("_v").asc_nulls_first())
    placed = (counted.withColumn("_end", F.sum("_n").over(order)).withColumn("_start", F.col("_end") - F.col("_n"))
              .where("_v IS NOT NULL")
              .withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in qs))))
              .withColumn("_h", F.col("q") * (F.col("_total") - 1))
              .withColumns({"_r0": F.floor("_h"), "_r1": F.ceil("_h")})
              .where(_holds("_r0", "_start", "_end") | _holds("_r1", "_start", "_end")))
    low = F.min(F.when(_holds("_r0", "_start", "_end"), F.col("_v")))
    high = F.min(F.when(_holds("_r1", "_start", "_end"), F.col("_v")))
    found = placed.groupBy(*keys, "q").agg(low.alias("_low"), high.alias("_high"), (F.first("_h") - F.first("_r0")).alias("_part"))
    missed = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
    return found.select(*keys, "q", F.when(F.col("_low").isNull() | F.col("_high").isNull(), missed).otherwise(
        F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("value"))


def exact_quantiles(df: DataFrame, value: str, qs: list[float], keys: list[str] = ()) -> DataFrame:
    """``(keys..., q, value)``: one row per group and quantile; nulls are ignored."""
    keys, qs = list(keys), sorted(set(map(float, qs)))
    v = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull())
    facts = rows.groupBy(*keys).agg(sketch(v, qs).alias("_f")) if keys else rows.agg(sketch(v, qs).alias("_f"))
    return ranked(rows, value, _kept(facts, keys), qs, keys)


def _slice_number(df: DataFrame) -> DataFrame:
    """``_s``: how many of the sorted ``_cuts`` lie below ``_v``, by bisection."""
    df = df.withColumn("_s", F.lit(0))
    step = SLICES // 2
    while step:
        df = df.withColumn("_s", F.when(
            F.get("_cuts", F.col("_s") + (step - 1)) < F.col("_v"), F.col("_s") + step)
            .otherwise(F.col("_s")))
        step //= 2
    return df


def _holds(rank: str, start: str, end: str):
    return (F.col(rank) >= F.col(start)) & (F.col(rank) < F.col(end))


def quantile_columns(df: DataFrame, value: str, named: dict[str, float],
                     keys: list[str] = ()) -> DataFrame:
    """Quantiles as columns: ``named`` maps an output column to its quantile."""
    return _as_columns(exact_quantiles(df, value, sorted(set(named.values())), keys), named, keys)


def _as_columns(long: DataFrame, named: dict[str, float], keys: list[str]) -> DataFrame:
    cols = [F.max(F.when(F.col("q") == F.lit(float(q)), F.col("value"))).alias(c)
            for c, q in named.items()]
    return long.groupBy(*keys).agg(*cols) if keys else long.agg(*cols)


def describe(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """count, mean, sample std, min, quartiles and max per column, per group when keyed.

    Long form: one row per group and column. The moments come with the first pass of the quartiles.
    """
    keys = list(keys)
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        keys, columns, "column_name", "_x")
    by, named = keys + ["column_name"], {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    facts = _kept(long.groupBy(*by).agg(
        F.count("_x").alias("count"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"),
        F.min("_x").alias("min"), F.max("_x").alias("max"), sketch(F.col("_x"), list(named.values())).alias("_f")), by)
    quart = _as_columns(ranked(long, "_x", facts, list(named.values()), by), named, by)
    return null_safe_join(facts.drop("_f"), quart, by, "left").select(
        *by, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def box_summary(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Quartiles, whiskers at the last point within 1.5 IQR of the box, and outlier count."""
    keys = list(keys)
    quart = quantile_columns(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    box = _kept(quart.select(*keys, F.array("q1", "median", "q3").alias("_q")), keys)
    joined = _looked_up(rows, box, keys).select(*keys, "_v", *(
        F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(("q1", "median", "q3")))).withColumn("_iqr", F.col("q3") - F.col("q1"))
    inside = ((F.col("_v") >= F.col("q1") - 1.5 * F.col("_iqr"))
              & (F.col("_v") <= F.col("q3") + 1.5 * F.col("_iqr")))
    # summed where the rows are read: no value is moved
    return joined.groupBy(*keys).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(1)).alias("outliers"))


def totals_below(counted: DataFrame, value: str, counts: list[str],
                 keys: list[str] = ()) -> DataFrame:
    """Add ``<count>_below``: sum of each count over the smaller values of the group.

    ``counted`` holds one row per group and value. Slices keep a huge group out of a single task:
    running sums are taken inside slices and shifted by the totals of the slices before.
    """
    keys = list(keys)
    marks = [i / SLICES for i in range(1, SLICES)]
    # always true, but naming every count keeps all uses of ``counted`` alike: one exchange
    present = sum((F.col(c) for c in counts[1:]), F.col(counts[0])) >= 0
    cuts = F.percentile_approx(F.when(present, F.col(value)), marks, 20 * SLICES)
    named = counted.withColumn("_v", F.col(value))
    if keys:
        cut = null_safe_join(named, counted.groupBy(*keys).agg(cuts.alias("_cuts")), keys)
    else:
        cut = named.withColumn("_cuts", counted.agg(cuts).scalar())
    sliced = _slice_number(cut).select(*keys, value, *counts, "_s")
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(*keys, "_s").agg(*[
        F.sum(F.when(present, F.col(c))).alias(f"_m{i}") for i, c in enumerate(counts)])
    offsets = offsets.select(*keys, "_s", *[
        F.coalesce(F.sum(f"_m{i}").over(before), F.lit(0)).alias(f"_o{i}")
        for i in range(len(counts))])
    inside = (Window.partitionBy(*keys, "_s").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = null_safe_join(sliced, offsets, keys + ["_s"])
    return placed.select(*keys, value, *counts, *[
        (F.col(f"_o{i}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_below")
        for i, c in enumerate(counts)])
