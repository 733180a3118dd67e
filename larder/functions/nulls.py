"""Rows with known keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without NULL in the named columns, as plain IS NOT NULL predicates.

    Unlike dropna, Spark moves these into the scan and recognises them when it compares
    plans, so that shuffles of the same table are shared.
    """
    return df.where(reduce(and_, (F.col(c).isNotNull() for c in columns)))
