"""Top rows with a fixed order on ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest(df: DataFrame, value: str, n: int, *ties: str) -> DataFrame:
    """The n rows with the largest value; only n rows per task reach the final merge."""
    return df.orderBy(F.col(value).desc_nulls_last(), *ties).limit(n)


def smallest(df: DataFrame, value: str, n: int, *ties: str) -> DataFrame:
    """The n rows with the smallest value."""
    return df.orderBy(F.col(value).asc_nulls_last(), *ties).limit(n)


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark limits each group before the shuffle."""
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def best_per_group(df: DataFrame, group: str, value: str, *ties: str) -> DataFrame:
    """The row of each group with the largest value."""
    order = [F.col(value).desc_nulls_last(), *[F.col(t) for t in ties]]
    return top_per_group(df, [group], order, 1, "_rank").drop("_rank")


def ranked(df: DataFrame, name: str, value: str, n: int, ascending: bool, *ties: str) -> DataFrame:
    """The first n rows under a ranking's name, numbered from 1.

    The numbering window sees the n rows of the limit and never the whole table.
    """
    cut = smallest(df, value, n, *ties) if ascending else largest(df, value, n, *ties)
    order = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    named = cut.withColumn("ranking", F.lit(name))
    window = Window.partitionBy("ranking").orderBy(order, *ties)
    return named.withColumn("rank", F.row_number().over(window))
