"""Winnowing document fingerprints, in DataFrame functions only.

The hashes of every ``GRAM`` tokens in a row are rolled together (the hash of 2k tokens comes from
those of its halves), and of every ``WINDOW`` neighbouring hashes the least is chosen, the rightmost
of equal ones. Hash and position are one number, so the windows' minima come from a few element-wise
minima of the array with itself, shifted by 1, 2, 4 ..., and equal choices fall together. Two texts
that share ``WINDOW + GRAM - 1`` tokens in a row share a chosen hash, at positions whose difference
is the passage's offset. A token is a word of at most 16 characters, or a single character of a longer
unbroken run, so that what is chosen depends on content alone in texts without blanks too. No row per
token is made, no array is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

GRAM = 4
WINDOW = 8
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,16}(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"
#: A chosen value holds 32 bits of hash above 31 bits that count down from the last position.
POSITION_BITS = 31
LAST = (1 << POSITION_BITS) - 1
#: Most slices of the table: 16 steps of a binary search, a literal of half a megabyte.
MOST_BUCKETS = 1 << 16


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), fn)[0]


def _zip(values: Column, by: int, fn) -> Column:
    """``fn`` of each element and the one ``by`` places on; ``by`` elements shorter, if it has more
    than that, else unchanged."""
    return _let(values, lambda a: F.when(F.size(a) <= by, a).otherwise(F.zip_with(
        F.slice(a, 1, F.size(a) - by), F.slice(a, by + 1, F.size(a) - by), fn)))


def _roll(by: int):
    return lambda a, b: F.shiftleft(a, by).bitwiseXOR(b)


def chosen(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Array of longs, hash above position, of the winnowed hashes of a text column (null: empty).

    ``gram`` and ``window`` are powers of two. Fewer tokens than ``gram`` are rolled together as far
    as their number goes, fewer hashes than ``window`` are one window; a text without tokens has an
    empty array. Equal texts have equal arrays. Positions count tokens.
    """
    values = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)),
                         lambda t: F.xxhash64(t))
    step = 1
    while step < gram:
        values = _zip(values, step, _roll(step))
        step *= 2
    values = F.transform(values, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), POSITION_BITS)
                         .bitwiseOR(F.lit(LAST) - i))
    return F.array_distinct(_let(values, lambda a: F.when(
        F.size(a) < window, F.array_compact(F.array(F.array_min(a)))).otherwise(_minima(a, window))))


def _minima(values: Column, window: int) -> Column:
    step = 1
    while step < window:
        values = _zip(values, step, lambda a, b: F.least(a, b))
        step *= 2
    return values


def hashes(choice: Column) -> Column:
    return F.array_distinct(F.transform(choice, lambda x: F.shiftrightunsigned(x, POSITION_BITS)))


def as_string(choice: Column) -> Column:
    """``hash:position`` of every choice, comma-joined, in the order of the text."""
    return F.array_join(F.transform(choice, lambda x: F.concat(
        F.lower(F.hex(F.shiftrightunsigned(x, POSITION_BITS))), F.lit(":"),
        (F.lit(LAST) - x.bitwiseAND(F.lit(LAST))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; 1 where both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return _let(F.struct(shared.alias("both"), (F.size(a) + F.size(b)).alias("all")), lambda s: F.when(
        s["all"] == 0, F.lit(1.0)).otherwise(s["both"] / (s["all"] - s["both"])))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``choice`` (array of longs, see :func:`chosen`) per row of ``docs``."""
    return docs.select("doc_id", chosen(F.col("text")).alias("choice"))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows ``doc_id, text`` (null: empty) with what :func:`compare` needs to look one row ahead.

    Rows are dealt to slices of ids of about equal size, by exact ids as bounds; the row on a bound
    is copied to the slice before, and the first row of all to the last slice, so that each slice
    knows what follows its last row. Texts move once.
    """
    spark = docs.sparkSession
    n = min(MOST_BUCKETS, buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"), key.alias("_key"))
    first, cuts = rows.agg(F.min("_key"), F.percentile_approx("_key", [i / n for i in range(1, n)] or [0.5],
                                                              10 * n)).first()
    bounds = sorted(set(cuts or ()) - {first})
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    if bounds:  # number of bounds up to the key, by bisection
        steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
        bucket = F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when(
            (at + s <= len(bounds)) & (F.try_element_at(table, at + s) <= F.col("_key")), at + s).otherwise(at))
    else:
        bucket = F.lit(0)
    rows = rows.withColumn("_bucket", bucket)
    on_bound = (F.col("_bucket") > 0) & (F.try_element_at(table, F.col("_bucket")) == F.col("_key")) if bounds else F.lit(False)
    places = F.array(F.struct(F.col("_bucket").alias("_slice"), F.lit(0).alias("_extra")),
                     F.when(on_bound, F.struct((F.col("_bucket") - 1).alias("_slice"), F.lit(1).alias("_extra"))),
                     F.when(F.col("_key") == F.lit(first), F.struct(F.lit(len(bounds)).alias("_slice"), F.lit(2).alias("_extra"))))
    return rows.select("doc_id", "text", "_key", F.inline(F.array_compact(places)))


def compare(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): ``doc_id, n_chars, edited, choice, edited_choice,
    near_edited, near_next``.

    ``edited`` is the text whose last half (rounded down) is replaced by as many first code points,
    or all, of the next row in the order of ``doc_id``, then text; the row after the last is the
    first. Null texts are empty ones, null ids come first, repeated ids follow each other, other
    columns are ignored; an empty table gives an empty one. Slices are even unless one id repeats
    in much of the table.
    """
    order = Window.partitionBy("_slice").orderBy("_extra", "_key", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs, buckets).withColumn("_next", F.lead("text").over(order))
    rows = rows.withColumn("edited", F.concat(
        F.left("text", F.length("text") - half), F.left(F.coalesce("_next", F.lit("")), half))).drop("_next")
    rows = (rows.withColumn("choice", chosen(F.col("text"))).withColumn("edited_choice", chosen(F.col("edited")))
            .withColumn("_own", hashes(F.col("choice"))))
    rows = rows.withColumn("_following", F.lead("_own").over(order)).where("_extra = 0")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "choice", "edited_choice",
                       likeness(F.col("_own"), hashes(F.col("edited_choice"))).alias("near_edited"),
                       likeness(F.col("_own"), F.col("_following")).alias("near_next"))
