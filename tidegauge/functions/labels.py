"""The two sentiment encodings. They are incompatible and never mixed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Sign of a sentiment in counting, and class id of a sentiment in learning.
SENTIMENT_SIGN = {"positive": 1, "neutral": 0, "negative": -1}
SENTIMENT_CLASS = {"positive": 1, "negative": 0, "neutral": 2}
# Label of each class id, in class order.
CLASS_LABELS = ["negative", "positive", "neutral"]


def map_values(column, mapping: dict) -> Column:
    """Value under each key of ``mapping``; anything else becomes null."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), F.col(column) if isinstance(column, str)
                            else column)


def sentiment_sign(column) -> Column:
    return map_values(column, SENTIMENT_SIGN)


def sentiment_class(column) -> Column:
    return map_values(column, SENTIMENT_CLASS)


def class_label(column) -> Column:
    """Label of a class id."""
    return map_values(column, dict(enumerate(CLASS_LABELS)))
