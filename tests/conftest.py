from __future__ import annotations

import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from larder.schema import FACT_SCHEMA  # noqa: E402
from larder.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("SF_DIR", "/root/testdata/sf0.001")


DEFAULT_ROW = dict(
    date=datetime.date(2024, 1, 1), store_id="S1", product_id="P1", category="Toys", region="East",
    inventory_level=10, units_sold=5, units_ordered=1, demand_forecast=6.0, price=10.0, discount=0,
    weather="Sunny", holiday_promotion=0, competitor_pricing=10.0, seasonality="Winter",
)


@pytest.fixture(scope="session")
def fact(spark):
    """fact([{column: value}, ...]): a fact table whose other columns keep a default."""

    def make(rows):
        whole = [{**DEFAULT_ROW, **row} for row in rows]
        return spark.createDataFrame([tuple(r[c] for c in FACT_SCHEMA.names) for r in whole], FACT_SCHEMA)

    return make


def day(n: int) -> datetime.date:
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
