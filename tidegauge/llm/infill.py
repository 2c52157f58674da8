"""Fill-in-the-middle transformation with counted quantifiers.

A text is a row of units (lines). Their number comes from ``regexp_count``; two hashed cuts a <= b go
into a pattern per row, ``unit{a}`` and ``unit{b-a}``, and one match captures prefix, middle and suffix,
which the replacement puts in the wanted order. Both counted groups are possessive: they run as loops,
so neither backtracking nor recursion grows with the number of units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.common import id_text

#: A line with its end, or the last one without. Possessive: the part before a line's end holds none.
LINE = r"(?:[^\n]*+\n|[^\n]++)"
#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Texts of 100 that are cut, and cut ones of 100 whose suffix comes first.
CUT, SUFFIX_FIRST = 100, 50


def draw(i: int, seed: int = SEED) -> Column:
    """The i-th of 8 unsigned 32-bit integers that follow from the id (a null id counts as none)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, unit: str = LINE, cut: int = CUT, suffix_first: int = SUFFIX_FIRST,
              seed: int = SEED) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` per row of ``docs`` (``doc_id, text``).

    ``n`` is the number of units. ``form`` is ``plain`` (the text as it is; no lengths) for empty and
    null texts, texts that hold a marker, and those that the draw leaves out; else ``psm`` or ``spm``.
    Cuts follow from the id alone, so repeated rows come out alike. Other columns are ignored, an empty
    table gives an empty one. ``unit`` must match without backtracking and tile any text.
    """
    rows = id_text(docs)
    n = F.regexp_count("text", F.lit(unit)).cast("long")
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = (F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= cut), "plain")
            .when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm"))
    rows = rows.select("doc_id", "text", n.alias("n"), *(draw(i, seed).alias(f"h{i}") for i in range(1, 5)))
    rows = rows.select("doc_id", "text", "n", form.alias("form"),
                       F.least(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)).alias("a"),
                       F.greatest(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)).alias("b"))
    pattern = F.format_string(rf"(?s)\A({unit}{{%d}}+)({unit}{{%d}}+)(.*+)\z", F.col("a"), F.col("b") - F.col("a"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    rows = rows.select("doc_id", "n", "form", output.alias("output"))
    parts = pieces()
    return rows.select("doc_id", "n", "form", F.length(parts["prefix"]).cast("long").alias("prefix_chars"),
                       F.length(parts["middle"]).cast("long").alias("middle_chars"), "output")


def pieces() -> Column:
    """Struct ``prefix, middle, suffix`` of ``output`` by its ``form``; null where it is plain."""
    def between(first, second):
        # the markers stand in no part, so the first of each is the one that was put there
        at = lambda x: F.instr("output", x)
        return (F.substring("output", F.lit(len(first) + 1), at(second) - 1 - len(first)),
                F.substring("output", at(second) + len(second), at(MIDDLE) - at(second) - len(second)))
    last = F.substring("output", F.instr("output", MIDDLE) + len(MIDDLE), F.length("output"))
    prefix, suffix = between(PREFIX, SUFFIX)
    other_suffix, other_prefix = between(SUFFIX, PREFIX)
    return (F.when(F.col("form") == "psm", F.struct(prefix.alias("prefix"), last.alias("middle"), suffix.alias("suffix")))
            .when(F.col("form") == "spm", F.struct(other_prefix.alias("prefix"), last.alias("middle"),
                                                   other_suffix.alias("suffix"))))


def restored() -> Column:
    """The text that ``output`` and ``form`` came from."""
    parts = pieces()
    return F.coalesce(F.concat(parts["prefix"], parts["middle"], parts["suffix"]), F.col("output"))
