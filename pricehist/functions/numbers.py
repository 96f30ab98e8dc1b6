"""Rounding, logarithms and exponentials to the last bit as SQL has them.

Spark's log and exp are Java's StrictMath, whose last bit differs from the C library's in one value of about forty. That decides results only
where values are compared or rounded at a tie, such as a price that is a whole number of half tenths of a percent over another."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def rounded(x: Column, places: int) -> Column:
    """A double rounded half away from zero, as DuckDB does it: x is scaled first and the product is rounded.

    F.round(x, places) rounds the decimal that x is written as, so that 29.849999999999998, whose tenfold is 298.5, would become 29.8 and not 29.9."""
    scale = F.lit(float(10**places))
    return F.round(x * scale) / scale


@F.pandas_udf(DoubleType())
def ln(x: pd.Series) -> pd.Series:
    """The C library's natural logarithm; null for null, NaN and what is not over 0."""
    return pd.Series([math.log(v) if v > 0 else None for v in x.tolist()], dtype="float64")


def _exp(v: float) -> float:
    try:
        return math.exp(v)
    except OverflowError:
        return math.inf


@F.pandas_udf(DoubleType())
def exp(x: pd.Series) -> pd.Series:
    """The C library's exponential; null for null and NaN."""
    return pd.Series([_exp(v) if v == v else None for v in x.tolist()], dtype="float64")
