"""TF-IDF over whole texts as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.functions.text import tokens

# Fixed value: vocabulary size of the text classifier.
MAX_TERMS = 2000


def term_counts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, term, tf)``. Every occurrence is counted before rows move.

    The null test never drops a term; it gives the vocabulary and the weighting the same plan, so
    that texts are tokenised once.
    """
    terms = docs.select(id_col, F.explode(tokens(text)).alias("term")).where("term IS NOT NULL")
    return terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_totals(docs: DataFrame, text: str) -> DataFrame:
    """``(term, total, df)`` of the corpus, each row a text of its own.

    Every text lists its distinct terms, then all; both are added up per term where the texts lie, so that
    what moves is bounded by the terms and not by the texts' lengths.
    """
    listed = docs.select(tokens(text).alias("_t")).withColumn("_d", F.array_distinct("_t"))
    terms = listed.select(F.size("_d").alias("_n"), F.posexplode(F.concat("_d", "_t")).alias("_i", "term"))
    return terms.groupBy("term").agg(F.count_if(F.col("_i") >= F.col("_n")).alias("total"),
                                     F.count_if(F.col("_i") < F.col("_n")).alias("df"))


def most_frequent(totals: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """The ``max_terms`` terms of the largest totals; ties go to the smaller term."""
    return totals.orderBy(F.col("total").desc(), "term").limit(max_terms)


def vocabulary(counts: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """Most frequent terms of the corpus with document frequency; ties go to the smaller term."""
    stats = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    return most_frequent(stats, max_terms)


def tf_idf(docs: DataFrame, id_col: str, text: str, max_terms: int = MAX_TERMS) -> DataFrame:
    """``(id, term, tfidf)`` with smooth idf ``ln((1+n)/(1+df)) + 1`` and rows of unit length."""
    counts = term_counts(docs, id_col, text)
    n = docs.agg(F.count(F.lit(1))).scalar()
    idf = F.ln((F.lit(1.0) + n) / (1.0 + F.col("df"))) + 1.0
    terms = vocabulary(counts, max_terms).withColumn("_idf", idf).select("term", "_idf")
    # a document has no more than max_terms rows; whether the terms are broadcast is Spark's choice
    weighted = counts.join(terms, "term").withColumn("_w", F.col("tf") * F.col("_idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return weighted.select(id_col, "term", (F.col("_w") / norm).alias("tfidf"))
