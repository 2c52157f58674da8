"""Helpers of the text operators: Arrow-batched row functions, seeded hashes, table reads."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch turned into Python objects at a time; bounds memory, not results.
CHUNK_ROWS = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) of ``docs``; other columns, whatever their names, go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"), *more)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes: whole texts, and sets of their hashes, pass through Python
    workers beside the JVM, and what a task holds of them must not depend on how long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def quoted(names: Iterable[str]) -> list[str]:
    """Column names that ``select`` takes as they are, dots included."""
    return [f"`{n.replace('`', '``')}`" for n in names]


def arrow_rows(schema: str, start: Callable[[], Callable[..., Iterable]]):
    """Function for ``mapInArrow``: ``start()`` runs once per task and returns a function from the
    values of one row to the rows to put out (tuples in the order of ``schema``)."""
    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = start()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                columns = [c.to_pylist() for c in batch.slice(at, CHUNK_ROWS).columns]
                rows = [out for row in zip(*columns) for out in fn(*row)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)
    return run


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[..., Iterable]]) -> DataFrame:
    return df.mapInArrow(arrow_rows(schema, start), schema)


def unit_hash(*columns: str | Column, seed: int) -> Column:
    """Uniform double in (0, 1) from a hash of the columns; the same on every rerun and layout."""
    mixed = F.xxhash64(F.lit(seed), *columns)
    # 52 bits: exact in a double, and neither 0 nor 1
    return (F.shiftrightunsigned(mixed, 12).cast("double") + 0.5) / F.lit(float(1 << 52))
