"""Trend and calendar regression from sums of products.

A day has terms: a constant, a trend, six weekdays and five yearly waves. Their products with each other and with
ln(y + 1), summed per series, are all that least squares needs. The sums are one aggregate, whose partial results
add up over any split of the days, and have the same size for any number of days.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WAVES = 5
N_TERMS = 2 + 6 + 2 * WAVES
RIDGE = 1e-6  # keeps the solution defined where terms coincide, as on a few days only
Z95 = 1.959963984540054


def terms(day: Column) -> list[Column]:
    """The terms of a day. The trend counts decades since 2000, the same for every series."""
    number = F.unix_date(day)
    angle = number * F.lit(2 * math.pi / 365.25)
    waves = [wave(angle * k) for k in range(1, WAVES + 1) for wave in (F.sin, F.cos)]
    weekdays = [F.when(F.weekday(day) == k, 1.0).otherwise(0.0) for k in range(1, 7)]
    return [F.lit(1.0), (number - 10957) / F.lit(3652.5), *weekdays, *waves]


def pairs() -> list[tuple[int, int]]:
    """Which terms are multiplied, in the order of the sums; number N_TERMS stands for ln(y + 1)."""
    return [(i, j) for i in range(N_TERMS + 1) for j in range(i, N_TERMS + 1)]


def sums_of_products(rows: DataFrame, keys: Sequence[str], day: str = "ds", y: str = "y") -> DataFrame:
    """Per series `sums`, the sums of all products in the order of `pairs`; rows without a day or with y missing, -1 or less do not count."""
    values = [*terms(F.col(day)), F.log(F.col(y) + 1)]
    named = rows.where(F.col(day).isNotNull() & (F.col(y) > -1)).select(
        *keys, *[v.alias(f"_t{i}") for i, v in enumerate(values)])
    return named.groupBy(*keys).agg(F.array(*[F.sum(F.col(f"_t{i}") * F.col(f"_t{j}")) for i, j in pairs()]).alias("sums"))


def solve(sums: np.ndarray) -> np.ndarray:
    """Weights of the terms, then the standard deviation of what they leave."""
    products = np.zeros((N_TERMS + 1, N_TERMS + 1))
    rows, columns = np.array(pairs()).T
    products[rows, columns] = products[columns, rows] = sums
    inner, outer = products[:-1, :-1], products[:-1, -1]
    weights = np.linalg.solve(inner + RIDGE * np.eye(N_TERMS), outer)
    rest = products[-1, -1] - 2 * weights @ outer + weights @ inner @ weights
    return np.append(weights, math.sqrt(max(rest / inner[0, 0], 0.0)))


def with_weights(sums: DataFrame) -> DataFrame:
    """`n` days and `weights` (the deviation last) in place of the sums; the solver sees one short row per series."""

    @F.pandas_udf("array<double>")
    def solved(found: pd.Series) -> pd.Series:
        return found.map(solve)

    return sums.withColumns({"n": F.get("sums", F.lit(0)).cast("long"), "weights": solved("sums")}).drop("sums")


def predictions(day: Column, weights: Column) -> dict[str, Column]:
    """The value of a day and its 95 % bounds."""
    level = sum((F.get(weights, F.lit(i)) * term for i, term in enumerate(terms(day))), F.lit(0.0))
    spread = F.get(weights, F.lit(N_TERMS)) * Z95
    return {name: F.exp(level + spread * sign) - 1 for name, sign in (("predicted", 0), ("lower", -1), ("upper", 1))}
