"""Sources by column name, one-sided slices, and quantiles of odd distributions."""

import numpy as np
import pytest

from larder.functions.quantiles import exact_quantiles
from larder.operators.filters import Slice, filter_slice
from larder.schema import FACT_FIELDS
from larder.sources import fact as source
from larder.session import fresh_path
from tests.conftest import day


def csv_of(spark, fact, change):
    path = fresh_path(spark, "test_csv")
    rows = fact([{"units_sold": 7, "units_ordered": 9}]).toDF(*[h for h, _, _ in FACT_FIELDS])
    change(rows).write.csv(path, header=True)
    return path


def test_columns_are_found_by_name(spark, fact):
    path = csv_of(spark, fact, lambda df: df.select(*reversed(df.columns)).selectExpr("1 AS extra", "*"))
    row = source.read_fact_csv(spark, path).first()
    assert (row.units_sold, row.units_ordered, row.product_id) == (7, 9, "P1")


def test_a_missing_column_is_an_error(spark, fact):
    with pytest.raises(ValueError, match="Units Sold"):
        source.read_fact_csv(spark, csv_of(spark, fact, lambda df: df.drop("Units Sold")))


def test_one_sided_slices(fact):
    df = fact([{"date": day(k)} for k in range(5)])
    assert filter_slice(df, Slice(start=str(day(3)))).count() == 2
    assert filter_slice(df, Slice(end=str(day(3)))).count() == 4


pick = np.random.default_rng(1)
DISTRIBUTIONS = {
    "two scales of outliers": np.append(pick.random(3000) * 100, [1e9, 1e18, -1e12]),
    "wide lognormal": pick.lognormal(0, 5, 3000),
    "infinities": np.append(pick.normal(0, 1, 3000), [np.inf, -np.inf]),
    "few values": pick.integers(0, 3, 3000).astype(float),
}


@pytest.mark.parametrize("name", DISTRIBUTIONS)
def test_quantiles(spark, name):
    values = DISTRIBUTIONS[name]
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    found = exact_quantiles(frame, "v", [0.1, 0.5, 0.99]).first()
    assert found.n == len(values)
    assert np.allclose(found.quantiles, np.quantile(values, [0.1, 0.5, 0.99]), rtol=1e-12)
