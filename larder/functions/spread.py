"""Wide one-row aggregates turned into long rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_column(df: DataFrame, columns: Sequence[str], **measures: Callable[[str], Column]) -> DataFrame:
    """One row per column: column_name and each measure, from a single wide aggregate.

    The fact rows are aggregated once and never multiplied; only the one-row result is
    turned into rows.
    """
    wide = df.agg(*[make(c).alias(f"{name}|{c}") for c in columns for name, make in measures.items()])
    entries = F.array(*[
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{name}|{c}`").alias(name) for name in measures])
        for c in columns
    ])
    return wide.select(F.inline(entries))
