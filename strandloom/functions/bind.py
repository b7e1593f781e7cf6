"""Name an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row.

    Needed where ``use`` mentions the value inside a higher-order function:
    a plain expression would be evaluated again for every array element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that filters above it cannot pull apart.

    The value passes a one-element generator.  A filter on an ordinary column is
    pushed down by copying the column's expression, and the optimiser then
    derives constraints for every alias in it, which takes exponential time for
    a rule over twenty columns.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))
