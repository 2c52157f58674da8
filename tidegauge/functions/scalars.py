"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def first_character(column) -> Column:
    return F.substring(column, 1, 1)


def by_first_character(column, letter: str, yes, no) -> Column:
    return F.when(first_character(column) == letter, F.lit(yes)).otherwise(F.lit(no))


def prefix_int(column, n: int) -> Column:
    """Integer in the first ``n`` characters, blanks trimmed; null when there is none."""
    return F.trim(F.substring(column, 1, n)).try_cast("int")


def suffix(column, n: int) -> Column:
    return F.right(column, F.lit(n))


def suffix_int(column, n: int) -> Column:
    return suffix(column, n).try_cast("int")


def frequency_number(column) -> Column:
    """Digits of a frequency such as ``10min``."""
    return F.regexp_extract(column, r"\d+", 0).try_cast("int")


def as_utc(column) -> Column:
    """Attach UTC to a zone-less time (the session zone is UTC)."""
    return F.col(column).cast("timestamp") if isinstance(column, str) else column.cast("timestamp")


def to_epoch(column) -> Column:
    """Whole seconds since the epoch, fraction cut off."""
    return F.unix_seconds(as_utc(column))


def from_epoch(column) -> Column:
    return F.timestamp_seconds(column)


def format_time(column) -> Column:
    """``2024-01-01 10:20:30+0000``"""
    return F.date_format(as_utc(column), "yyyy-MM-dd HH:mm:ssxx")


def shift_time(column, minutes: int) -> Column:
    return F.col(column) + F.make_dt_interval(mins=F.lit(minutes))


def reciprocal(column) -> Column:
    """1/x with the floating-point answer for zero: infinity, not an error."""
    x = F.col(column) if isinstance(column, str) else column
    return F.when(x == 0, F.lit(float("inf"))).otherwise(F.lit(1.0) / F.nullif(x, F.lit(0.0)))


def divide(a, b) -> Column:
    """x/y with floating-point answers for a zero divisor: +-infinity or NaN."""
    a, b = a.cast("double"), b.cast("double")
    return (F.when(b != 0, a / F.nullif(b, F.lit(0.0)))
            .when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
            .when(a == 0, F.lit(float("nan"))))
