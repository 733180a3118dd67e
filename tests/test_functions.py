import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions import columns as C
from larder.functions.quantiles import exact_quantiles, quantile
from larder.params import Params


def values(df, *expressions):
    return [tuple(r) for r in df.select(*expressions).collect()]


def test_guards(fact):
    df = fact([
        dict(units_sold=0, inventory_level=0, demand_forecast=0.0),
        dict(units_sold=0, inventory_level=50, demand_forecast=-2.0),
        dict(units_sold=4, inventory_level=8, demand_forecast=None),
    ])
    got = values(df, C.inventory_sales_ratio(), C.sell_through_rate(), C.forecast_accuracy(), C.supply_gap())
    assert got == [(None, None, None, 0), (None, 0.0, 2.0, 50), (2.0, 4 / 12, None, 4)]


def test_status_edges(fact):
    df = fact([dict(units_sold=10, inventory_level=i) for i in (9, 10, 15, 16, None)])
    assert [r[0] for r in values(df, C.supply_status())] == [
        "Undersupplied", "Optimal", "Optimal", "Oversupplied", "Unknown"]


def test_bucket_edges(spark):
    edges = [-100.0, -99.9, -10.0, -5.0, -2.0, 0.0, 2.0, 5.0, 10.0, 100.0, 100.1, None]
    df = spark.createDataFrame([(x,) for x in edges], "x double")
    got = values(df, C.price_bucket_no(F.col("x")), C.price_bucket_label(C.price_bucket_no(F.col("x"))))
    assert [g[0] for g in got] == [None, 0, 0, 1, 2, 3, 4, 5, 6, 7, None, None]
    assert [g[1] for g in got][1:10:4] == ["<-10%", "-2% to 0%", ">10%"]
    assert C.price_bucket_labels(Params().price_diff_bins) == [
        "<-10%", "-10% to -5%", "-5% to -2%", "-2% to 0%", "0% to 2%", "2% to 5%", "5% to 10%", ">10%"]


def test_clip_log_flag(spark):
    df = spark.createDataFrame([(-1.0,), (5.0,), (11.0,), (None,)], "x double")
    assert [r[0] for r in values(df, C.clip(F.col("x"), 0.0, 10.0))] == [0.0, 5.0, 10.0, None]
    assert [r[0] for r in values(df, C.log_transform(F.col("x"), F.col("x"))[0])] == [None, math.log(5), math.log(11), None]
    assert [r[0] for r in values(df, C.recode_flag(F.lit(1)))] == ["Yes"] * 4


def test_advice_tiers(spark):
    df = spark.createDataFrame([(-0.4,), (-0.5,), (-1.0,), (-1.5,)], "e double")
    got = [r[0] for r in values(df, C.product_price_action(F.col("e"), F.lit(12.345)))]
    assert [g.split()[0] for g in got] == ["Increase", "Small", "Maintain", "Decrease"]
    assert "$12.3" in got[0]


CASES = {
    "ties": [1.0] * 500 + [2.0],
    "even": [1.0, 2.0, 3.0, 4.0],
    "one": [7.5],
    "tail": [10.0**k for k in range(-12, 13)] + [1e300],
    "negative": list(np.linspace(-5, 5, 101)),
    "close": [1 + k * 1e-15 for k in range(50)],
    "random": list(np.random.default_rng(1).lognormal(3, 2, 3000)),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("most_values", [100, 1 << 20])
def test_quantiles_equal_numpy(spark, name, most_values):
    data, probs = CASES[name], [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(float(x),) for x in data] + [(None,)], "x double")
    row = exact_quantiles(df, "x", probs, most_values=most_values, accuracy=200).first()
    assert row["n"] == len(data)
    assert row["quantiles"] == pytest.approx(list(np.quantile(data, probs)), rel=1e-12, abs=1e-300)


def test_quantiles_per_group(spark):
    groups = {"a": [3.0, 1.0, 2.0], "b": [5.0], "c": [float(x) for x in range(1000)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("d", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r["quantiles"] for r in exact_quantiles(df, "x", [0.25, 0.5], ["k"]).collect()}
    assert got == {k: pytest.approx(list(np.quantile(v, [0.25, 0.5]))) for k, v in groups.items()}


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([], "x double")
    assert quantile(df, "x", 0.5) is None
