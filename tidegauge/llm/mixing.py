"""Mixing sources to target weights.

Targets are shared out by weight under a cap per source. A source takes its documents in the order
of Efraimidis-Spirakis keys (exponential with the document's quality weight as rate): as many
complete epochs as fit into the target, then a prefix of the order for the rest. The prefix is found
without sorting a source: keys fall into 2^12 cells and each of those into 2^12 more, sizes are
summed per cell, and only the rows of the one cell that holds the cut are put in order. Cells are even
in the logarithm of the key, where a cell holds at most some 2 in a million of a source's documents
(by expectation), whatever their weights are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.llm.common import WORD, quoted
from tidegauge.operators.joins import null_safe_join
from tidegauge.session import spool

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix holds, and how often a source may be repeated.
TOTAL = 1.5
REPEATS = 2
#: Mean word length, in characters with the space after it, of ordinary prose.
PROSE = 6.0
CELLS = 4096


def size() -> Column:
    """Number of words of ``text``; a null text has none."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight() -> Column:
    """In (0, 1], highest where the mean word length is that of prose; 1 for a text without words."""
    mean = F.length("text") / F.nullif(F.col("_size"), F.lit(0))
    return F.coalesce(1.0 / (1.0 + F.abs(mean - PROSE) / PROSE), F.lit(1.0))


def uniform() -> Column:
    """In (0, 1), from the MD5 of the id, so that another engine can repeat it."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source).

    ``total`` times all words is shared by weight; a source gets at most ``repeats`` times its size
    and the excess is shared again by weight. That ends at one level: target = min(cap, level *
    weight), found by putting the sources in order of cap over weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.lit(list(weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", w.cast("double").alias("w"),
                        (F.col("source_size") * float(repeats)).alias("cap"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * total
    rows = rows.withColumn("level", (budget - full) / left)
    reached = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(
        F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(
        Window.partitionBy())
    level = F.coalesce(reached["level"], F.lit(float("inf")))
    return rows.select("source", "source_size", F.least("cap", level * F.col("w")).alias("target"))


def _prefix(cells: DataFrame, cell: str, rest: Column) -> DataFrame:
    """The cell that holds the cut of each source, and the words before it."""
    w = Window.partitionBy("source").orderBy(cell)
    return (cells.withColumn("_to", F.col("_before") + F.sum("_words").over(w))
            .where(F.col("_to") > rest).groupBy("source")
            .agg(F.min(F.struct(F.col(cell), (F.col("_to") - F.col("_words")).alias("before"))).alias("cut")))


def mix(docs: DataFrame, keep: list[str] | None = None, weight: Column | None = None, **targets) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text, source``): ``doc_id, size, source, source_size,
    target, copies`` and, as struct ``row``, the columns ``keep``.

    ``copies`` is how often the mix takes the document: the complete epochs of its source, and one
    more while the middle of the document, in key order, lies within what is left of the target; the
    taken words of a source miss its target by less than half a document. A null source is a source
    of its own and comes last. Texts without words have size 0 and move no sum. Repeated rows are
    taken like any others, ties of the key go to the smaller id; a null id is hashed as an empty
    one. ``weight`` (over ``text`` and ``_size``) must be positive. An empty table gives an empty one.
    """
    # 2^17 cells to a doubling of the key, over 128 doublings: an exponential variable's logarithm has
    # a density below 1/e, and a weight only moves it
    at = F.floor((F.log2("key") + 64) * float(CELLS * CELLS >> 7))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       "text", F.struct(*quoted(keep or ["doc_id"])).alias("row"))
    rows = (rows.withColumn("_size", size()).withColumn("_u", uniform())
            .withColumn("_w", quality_weight() if weight is None else weight)
            .select("doc_id", "source", F.col("_size").alias("size"), "row", (-F.log("_u") / F.col("_w")).alias("key"))
            .withColumn("cell", F.greatest(F.lit(0), F.least(at, F.lit(CELLS * CELLS - 1)))))
    rows = spool(rows)
    coarse = F.floor(F.col("cell") / CELLS)
    sums = spool(rows.groupBy("source", coarse.alias("_coarse")).agg(F.sum("size").alias("_words")))
    shares = source_targets(sums.groupBy("source").agg(F.sum("_words").alias("source_size")), **targets)
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    shares = shares.withColumn("epochs", epochs).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # tables of one row per source: Spark measures them before it chooses a join
    first = _prefix(null_safe_join(sums.withColumn("_before", F.lit(0)), shares, ["source"]), "_coarse", F.col("rest"))
    shares = spool(null_safe_join(shares, first.select("source", F.col("cut._coarse").alias("_cut1"), F.col(
        "cut.before").alias("_before")), ["source"], "left"))
    inside = null_safe_join(rows.withColumn("_coarse", coarse), shares, ["source"]).where("_coarse = _cut1")
    fine = inside.groupBy("source", "cell", "_before", "rest").agg(F.sum("size").alias("_words"))
    second = _prefix(fine, "cell", F.col("rest"))
    shares = spool(null_safe_join(shares.drop("_before"), second.select(
        "source", F.col("cut.cell").alias("_cut2"), F.col("cut.before").alias("_before")), ["source"], "left"))

    placed = null_safe_join(rows, shares, ["source"])
    whole = placed.where("_cut2 IS NULL OR cell != _cut2").withColumn(
        "_more", F.when(F.col("_cut2").isNull() | (F.col("cell") < F.col("_cut2")), 1).otherwise(0))
    order = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("_before") + F.sum("size").over(order) - F.col("size") / 2
    edge = placed.where("cell = _cut2").withColumn("_more", F.when(middle <= F.col("rest"), 1).otherwise(0))
    # with nothing left of the target no document is taken once more
    more = F.when(F.col("rest") > 0, F.col("_more")).otherwise(0)
    return whole.unionByName(edge).select("doc_id", "size", "source", "source_size", "target",
                                          (F.col("epochs") + more).cast("int").alias("copies"), "row")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    taken = mix(docs, keep=docs.columns, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
