"""Reproducible randomness: numbers that follow from a row's ids and a seed alone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unit_hash(*ids: str | Column, seed: int = 0) -> Column:
    """Uniform in [0, 1) with 52 bits, from the MD5 of the ids: no file layout changes it, and any
    engine can repeat it."""
    text = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in ids]
    digest = F.md5(F.concat_ws("|", *text, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def sql_unit_hash(*ids: str, seed: int = 0) -> str:
    """The same in DuckDB."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(ids)}, {seed})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
