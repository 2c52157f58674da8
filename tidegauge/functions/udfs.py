"""Arrow-batched fallbacks for functions that have no native expression.

Native expressions come first; these exist for user code that cannot be written as one.
"""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F


def apply_vectorised(fn: Callable, returns: str, *columns) -> Column:
    """Call ``fn`` on pandas Series, one per column, one Arrow batch at a time."""
    def call(*parts: pd.Series) -> pd.Series:
        return fn(*parts)
    return F.pandas_udf(call, returns)(*columns)
