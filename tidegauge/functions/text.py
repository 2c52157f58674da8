"""Characters and tokens of whole texts, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: a token is a run of at least two letters, digits or underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def characters(df: DataFrame, id_col: str, text: str, out: str = "chars") -> DataFrame:
    """One row per text that is not empty: its id and its characters in order, as an array."""
    return df.where(F.length(text) > 0).select(id_col, F.split(text, "").alias(out))


def tokens(text) -> Column:
    """Lower-cased tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def text_chunks(df: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """Full chunks of ``size`` characters, ``(id, chunk, text)``; the remainder is dropped.

    One linear pass over each text where it lies: no row per character and no shuffle.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{{size}}}"), F.lit(0))
    return df.select(id_col, F.posexplode(pieces).alias("chunk", "text")).withColumn(
        "chunk", F.col("chunk").cast("long"))


def character_vocabulary(docs: DataFrame, text: str, ch: str = "ch") -> DataFrame:
    """Distinct characters numbered in code-point order: ``(ch, code)``.

    Each text is reduced to its own distinct characters before any row is made; the size of the
    result is bounded by the character set, not by the corpus.
    """
    own = F.array_distinct(F.split(F.col(text), ""))
    seen = docs.where(F.length(text) > 0).select(F.explode(own).alias(ch)).distinct()
    listed = seen.agg(F.array_sort(F.collect_set(ch)).alias("_all"))
    return listed.select(F.posexplode("_all").alias("code", ch)).select(ch, "code")


def _by_number(vocabulary: DataFrame, number: Column, value: str) -> Column:
    """Array that holds each row's value at its number, null at all others.

    Numbers are code points or codes, so the array's length is bounded by the character set.
    """
    pairs = vocabulary.agg(F.array_sort(F.collect_list(F.struct(number.cast("int").alias("n"), F.col(value).alias("v")))).alias("p"))
    none = F.lit(None).cast(vocabulary.schema[value].dataType)

    def place(p, i):
        gap = p["n"] - F.when(i == 0, -1).otherwise(F.get("p", i - 1)["n"]) - 1
        twice = F.raise_error(F.concat(F.lit("two characters share number "), p["n"].cast("string"))).cast("int")
        return F.concat(F.array_repeat(none, F.when(gap < 0, twice).otherwise(gap)), F.array(p["v"]))
    return pairs.select(F.flatten(F.transform("p", place)).alias("numbered")).scalar()


def encode_characters(texts: DataFrame, vocabulary: DataFrame, chars: str = "chars", out: str = "codes") -> DataFrame:
    """Attach the codes of each text's characters, as an array; a character without a code has null.

    Looked up by code point where the text lies: no row per character and no shuffle.
    """
    codes = _by_number(vocabulary, F.ascii("ch"), "code")
    return texts.withColumn("_codes", codes).withColumn(out, F.transform(
        chars, lambda c: F.get("_codes", F.ascii(c)))).drop("_codes")


def decode_characters(coded: DataFrame, vocabulary: DataFrame, codes: str = "codes", out: str = "chars") -> DataFrame:
    """Attach the characters of each text's codes, as an array."""
    known = _by_number(vocabulary, F.col("code"), "ch")
    return coded.withColumn("_known", known).withColumn(out, F.transform(
        codes, lambda k: F.get("_known", k))).drop("_known")
