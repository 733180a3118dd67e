"""Sums and counts by key, which stand in for the fact when only means and sums are asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import durable


def summed(df: DataFrame, keys: Sequence[str], **measures: Column) -> DataFrame:
    """One row per key combination with each measure's sum and, as n_<measure>, its count.

    It is written once, so that any number of tables cost one pass over the fact.
    """
    parts = [part for name, column in measures.items()
             for part in (F.sum(column).alias(name), F.count(column).alias(f"n_{name}"))]
    return durable(df.groupBy(*keys).agg(*parts))


def mean(df: DataFrame, name: str, column: Column | None = None) -> Column:
    """The mean of a measure, from rows or from their sums and counts."""
    if f"n_{name}" in df.columns:
        return F.sum(name) / F.nullif(F.sum(f"n_{name}"), F.lit(0))
    return F.avg(name if column is None else column)


def count(df: DataFrame, name: str) -> Column:
    """The number of known values of a measure, from rows or from their counts."""
    return F.sum(f"n_{name}") if f"n_{name}" in df.columns else F.count(name)
