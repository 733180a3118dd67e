"""Every deterministic query equals its SQL twin on the whole test tables."""

import pytest

from larder.plans.oracle import ORACLE
from larder.plans.queries import QUERIES
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, folder, con, name):
    assert differences(QUERIES[name](spark, folder), con, ORACLE[name]) == []


def test_a_difference_is_found(spark, folder, con):
    frame = QUERIES["y8_supply_overall"](spark, folder)
    assert differences(frame, con, ORACLE["y8_supply_overall"].replace("avg(gap)", "avg(gap) + 0.001"))
    assert differences(frame, con, ORACLE["y9_category_gap_extremes"])


def test_names():
    assert set(ORACLE) <= set(QUERIES)
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only == {
        "r1_key_metrics", "f6_seasonal_forecast", "f6_seasonal_moving_average", "f13_random_forest_forecast",
        "f14_feature_importance", "f15_actual_vs_predicted", "f17_regression_forecast", "f18_model_comparison",
        "f19_forecast_leaderboard",
    }
