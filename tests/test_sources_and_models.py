import math
import subprocess
import sys
from dataclasses import replace

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from larder.functions import regression, seasonal_ar
from larder.operators import forecast as FC
from larder.operators import models as M
from larder.operators.filters import Slice, filter_slice, latest_day
from larder.params import DEFAULTS
from larder.plans.queries import PANEL, STORE_DAY
from larder.schema import FACT_FIELDS, FACT_SCHEMA
from larder.sources import fact as source
from larder.sources import results
from tests.conftest import day


def test_csv_round_trip(spark, folder, tmp_path):
    df = source.retail_view(spark, folder, FACT_SCHEMA.names)
    path = str(tmp_path / "fact.csv")
    df.toDF(*[header for header, _, _ in FACT_FIELDS]).write.csv(path, header=True)
    back = source.read_fact_csv(spark, path)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in FACT_SCHEMA]
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_bad_dates_become_null(spark, tmp_path):
    path = tmp_path / "bad.csv"
    header = ",".join(name for name, _, _ in FACT_FIELDS)
    path.write_text(f"{header}\n2022-13-01,S1,P1,Toys,East,1,2,3,x,5.5,0,Sunny,1,2.5,Winter\n")
    row = source.read_fact_csv(spark, str(path)).first()
    assert row["date"] is None and row["demand_forecast"] is None and row["price"] == 5.5


def test_month_folders_prune(spark, folder, tmp_path):
    df = source.retail_view(spark, folder, FACT_SCHEMA.names)
    path = str(tmp_path / "fact")
    source.write_fact(df, path)
    assert source.read_fact_parquet(spark, path).count() == df.count()
    rows = source.read_fact_parquet(spark, path, months=True)
    chosen = Slice(start="1996-02-10", end="1996-03-05")
    for part, folders in ((filter_slice(rows, chosen), 2), (latest_day(rows), 1)):
        scan = part._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
        assert "month_start" in scan
        assert part.select(F.split(F.input_file_name(), "month_start=")[1][0:10]).distinct().count() <= folders
    assert filter_slice(rows, chosen).count() == filter_slice(df, chosen).count()
    assert latest_day(rows).count() == latest_day(df).count()


def test_unused_dimensions_are_not_joined(spark, folder):
    df = source.retail_view(spark, folder, ["date", "units_sold"])
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == source.retail_view(spark, folder).count()


def test_results(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5)], "k string, n long, x double")
    path = str(tmp_path / "result")
    results.write_json(df, path)
    assert results.read_results(spark, path, df.schema).collect() == df.collect()
    missing = results.read_results(spark, str(tmp_path / "none"), df.schema)
    assert missing.count() == 0 and missing.schema == df.schema


def test_sample_and_stats(spark):
    df = spark.range(1000)
    assert results.sample_rows(df, 100).distinct().count() == 100
    assert results.sample_rows(df, 5000).count() == 1000
    stats = results.run_stats(df).first()
    assert (stats["n_rows"], stats["n_columns"], stats["data_bytes"]) == (1000, 1, 8000)
    first = sorted(r.id for r in results.sample_rows(df, 100).collect())
    assert first == sorted(r.id for r in results.sample_rows(df.repartition(7), 100).collect())
    assert first != sorted(r.id for r in results.sample_rows(df, 100, seed=1).collect())


def test_figures_of_a_load(spark):
    load = results.Load(spark.createDataFrame([("ab", 1), (None, 2), ("é", None)], "t string, n int"))
    load.rows.write.format("noop").mode("overwrite").save()
    stats = load.stats()
    assert (stats["n_rows"], stats["n_columns"], stats["data_bytes"]) == (3, 2, 2 + 2 + 8) and stats["seconds"] > 0


def test_training_does_not_depend_on_partitions(spark, folder):
    df = source.retail_view(spark, folder, STORE_DAY.split())
    few = replace(DEFAULTS, trees=3, max_depth=5)
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts in ("4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = M.random_forest_forecast(df, few).predictions().collect()
        found.append(sorted((r.date, r.store_id, r.predicted) for r in rows))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0]) > 0
    assert [M.training_partitions(n) for n in (0, 10, 100_001, 10_000_000)] == [1, 1, 2, 100]


def test_held_out_values_change_no_prediction(spark):
    values = [100 + 10 * (i % 7) + i % 13 for i in range(150)]
    few = replace(DEFAULTS, trees=5, max_depth=5)

    def predicted(make, series):
        return [r.predicted for r in make(panel(spark, series)).orderBy("ds").collect()]

    for make in (FC.naive_holdout, lambda p: M.seasonal_holdout(p, last_days=30), lambda p: M.regression_holdout(p, last_days=30),
                 lambda p: M.forest_holdout(p, few)):
        first, second = predicted(make, values), predicted(make, values[:-30] + [0.0] * 30)
        assert len(first) == 30 and first == second
    naive = predicted(FC.naive_holdout, values)
    assert naive == [values[120 - 7 + h % 7] for h in range(30)]


def panel(spark, values, kind="total", name="all"):
    return spark.createDataFrame([(kind, name, day(i), float(v)) for i, v in enumerate(values)],
                                 "kind string, series_id string, ds date, y double")


def test_seasonal_forecast_shape(spark, folder):
    series = FC.series_panel(source.retail_view(spark, folder, PANEL.split()))
    rows = M.seasonal_forecast(series).collect()
    per_series = {}
    for r in rows:
        per_series.setdefault((r["kind"], r["series_id"]), []).append(r)
    assert all(len(v) == 30 for v in per_series.values()) and len(per_series) == series.select("kind", "series_id").distinct().count()
    assert all(r["lower"] <= r["predicted"] <= r["upper"] and r["error"] is None for r in rows)
    last = {(r["kind"], r["series_id"]): r["last"] for r in series.groupBy("kind", "series_id").agg(F.max("ds").alias("last")).collect()}
    for key, got in per_series.items():
        assert sorted((r["ds"] - last[key]).days for r in got) == list(range(1, 31))


def test_weekly_pattern_is_continued(spark):
    values = [100 + 10 * (i % 7) + i for i in range(200)]
    for forecast in (M.seasonal_forecast, M.regression_forecast):
        got = forecast(panel(spark, values)).orderBy("ds").collect()
        assert len(got) == 30
    exact = M.seasonal_forecast(panel(spark, values)).orderBy("ds").collect()
    assert [r["predicted"] for r in exact] == pytest.approx([100 + 10 * (i % 7) + i for i in range(200, 230)], rel=1e-3)


def test_regression_equals_least_squares(spark):
    def plain(i):  # factors, as the model has them
        return math.exp(5 + 0.1 * (i % 7) + 0.0003 * i) - 1

    values = [plain(i) * (1 + 0.02 * (i * 7919 % 13 - 6) / 6) for i in range(800)]
    both = panel(spark, values).unionByName(panel(spark, values[:400], "category", "A")).unionByName(
        panel(spark, [-1.0, -5.0], "category", "none"))
    table = both.where("kind = 'total'").orderBy("ds").select("y", *[
        t.cast("double").alias(f"t{i}") for i, t in enumerate(regression.terms(F.col("ds")))]).collect()
    x, y = np.array([r[1:] for r in table]), np.log(np.array([r[0] for r in table]) + 1)
    weights, *_ = np.linalg.lstsq(x, y, rcond=None)
    found = {r["kind"]: r for r in M.regression_weights(both).collect()}
    assert found["total"]["n"] == 800 and found["category"]["n"] == 400 and len(found) == 2
    assert x @ np.array(found["total"]["weights"][:-1]) == pytest.approx(x @ weights, abs=1e-5)
    assert found["total"]["weights"][-1] == pytest.approx(np.std(y - x @ weights), rel=1e-3)
    ahead = M.regression_forecast(both).where("kind = 'total'").orderBy("ds").collect()
    assert [r["predicted"] for r in ahead] == pytest.approx([plain(i) for i in range(800, 830)], rel=0.02)
    assert all(r["lower"] <= r["predicted"] <= r["upper"] for r in ahead)
    assert M.regression_forecast(both.limit(0)).count() == M.regression_holdout(both.limit(0)).count() == 0


def test_sums_of_products_add_up(spark):
    days = panel(spark, range(90))
    whole, *parts = (np.array(regression.sums_of_products(rows, FC.SERIES).first()["sums"]) for rows in (
        days, days.where("y < 31"), days.where("y >= 31")))
    assert whole == pytest.approx(sum(parts)) and len(whole) == len(regression.pairs()) and whole[0] == 90


def simulated(orders, point, n, seed=3):
    """A series by the model's own recursion, term by term, and its errors."""
    levels, shocks = seasonal_ar._polynomials(np.array(point), orders)
    levels = np.convolve(levels, orders.differences())
    e, y = np.random.default_rng(seed).normal(size=n), []
    for t in range(n):
        y.append(sum(w * e[t - k] for k, w in enumerate(shocks) if k <= t)
                 - sum(w * y[t - k] for k, w in enumerate(levels) if 0 < k <= t))
    return np.array(y), e, levels, shocks


ORDERS = [((1, 1, 1), (1, 1, 0, 7), [0.5, -0.4, -0.3]), ((2, 0, 1), (0, 1, 1, 7), [0.5, -0.3, 0.4, -0.5]),
          ((0, 1, 1), (0, 1, 1, 12), [-0.4, -0.6]), ((2, 1, 0), (0, 0, 0, 0), [0.4, 0.3]), ((0, 1, 0), (0, 1, 0, 7), [])]


@pytest.mark.parametrize("order, seasonal_order, point", ORDERS)
def test_orders_recursion_from_given_coefficients(order, seasonal_order, point):
    orders = seasonal_ar.Orders(order, seasonal_order)
    y, e, levels, shocks = simulated(orders, point, 400)
    z = np.convolve(y, orders.differences(), "valid")
    own = seasonal_ar._polynomials(np.array(point), orders)[0]
    found = seasonal_ar.one_step_errors(z, own, shocks)
    assert found[-200:] == pytest.approx(e[-200:], abs=1e-3)
    mean, spread = seasonal_ar.forecast(y, seasonal_ar.Fit(levels, shocks, found, True), 40)
    path, padded = list(y), np.r_[e[: 400 - len(found)], found, np.zeros(40)]
    for t in range(400, 440):  # the model's equation with all later errors zero
        path.append(sum(w * padded[t - k] for k, w in enumerate(shocks)) - sum(
            w * path[t - k] for k, w in enumerate(levels) if k))
    assert mean == pytest.approx(path[400:]) and (np.diff(spread) >= -1e-9).all()


@pytest.mark.parametrize("order, seasonal_order, point", ORDERS)
def test_orders_are_recovered(order, seasonal_order, point):
    orders = seasonal_ar.Orders(order, seasonal_order)
    y, _, levels, shocks = simulated(orders, point, 3000)
    fit = seasonal_ar.fit_seasonal_ar(y, orders, 30, 50)
    assert fit.converged and len(fit.levels) == len(levels) and len(fit.shocks) == len(shocks)
    assert fit.levels == pytest.approx(levels, abs=0.12) and fit.shocks == pytest.approx(shocks, abs=0.12)
    if point:
        assert not seasonal_ar.fit_seasonal_ar(y, orders, 30, 0).converged


def test_fit_at_the_bound_comes_to_rest():
    orders = seasonal_ar.Orders()
    for seed in range(6):  # differences of plain noise draw the moving average to its bound
        y = np.random.default_rng(seed).normal(size=700)
        fit = seasonal_ar.fit_seasonal_ar(y, orders, 30, 50)
        z, least = np.convolve(y, orders.differences(), "valid"), fit.errors @ fit.errors
        assert fit.converged
        levels = np.polydiv(fit.levels[::-1], orders.differences()[::-1])[0][::-1]
        a, b = -levels[1], -levels[7]
        for da, db in ((0.02, 0), (-0.02, 0), (0, 0.02), (0, -0.02), (0.02, 0.02)):
            near, shocks = seasonal_ar._polynomials(np.array([a + da, b + db, fit.shocks[1]]), orders)
            tried = seasonal_ar.one_step_errors(z, near, shocks)
            assert tried @ tried > least


def test_unsupported_orders_are_an_error(spark):
    for order, seasonal_order in (((1, 1), (1, 1, 0, 7)), ((1, -1, 1), (1, 1, 0, 7)), ((1, 1.5, 1), (1, 1, 0, 7)),
                                  ((7, 1, 1), (1, 1, 0, 7)), ((1, 1, 1), (1, 1, 0, 1)), ((1, 1, 1), (1, 1, 0))):
        with pytest.raises(ValueError):
            M.seasonal_forecast(panel(spark, range(9)), replace(DEFAULTS, order=order, seasonal_order=seasonal_order))


def test_orders_reach_the_forecast(spark):
    values = [100 + 10 * (i % 7) + i for i in range(120)]
    params = replace(DEFAULTS, order=(0, 1, 0), seasonal_order=(0, 1, 0, 7))
    rows = M.seasonal_forecast(panel(spark, values), params).orderBy("ds").collect()
    assert [r["predicted"] for r in rows] == pytest.approx([100 + 10 * (i % 7) + i for i in range(120, 150)])
    assert all(r["converged"] for r in rows)
    asked = replace(DEFAULTS, min_fit_days=200)
    failed = M.seasonal_forecast(panel(spark, values), asked).collect()
    assert [(r["error"], r["converged"]) for r in failed] == [("only 120 days", None)]
    assert M.regression_forecast(panel(spark, values), asked).first()["error"] == "only 120 days"
    assert M.seasonal_forecast(panel(spark, values).limit(0)).count() == 0


def test_short_and_constant_series(spark):
    both = panel(spark, range(10), "product", "short").unionByName(panel(spark, [5.0] * 100, "product", "flat"))
    rows = M.seasonal_forecast(both).collect()
    assert [r["error"] for r in rows if r["series_id"] == "short"] == ["only 10 days"]
    flat = [r for r in rows if r["series_id"] == "flat"]
    assert len(flat) == 30 and all(math.isclose(r["predicted"], 5.0, abs_tol=1e-6) for r in flat)
    assert M.regression_forecast(panel(spark, range(10))).first()["error"] == "only 10 days"


def test_holdout_scores_the_last_part(spark):
    rows = M.seasonal_holdout(panel(spark, [float(i % 7) for i in range(100)])).collect()
    assert len(rows) == 20 and all(abs(r["y"] - r["predicted"]) < 1e-3 for r in rows)
    assert FC.forecast_leaderboard(M.seasonal_holdout(panel(spark, [float(i % 7) for i in range(100)], "product", "P"))).first()["rank"] == 1


def test_forest(spark, folder):
    df = source.retail_view(spark, folder, STORE_DAY.split())
    fit = M.random_forest_forecast(df, replace(DEFAULTS, trees=3, max_depth=4))
    split = {r["split"]: r["count"] for r in fit.features.groupBy("split").count().collect()}
    assert split["train"] == int((split["train"] + split["test"]) * 0.8)
    assert fit.predictions().count() == split["test"]
    importance = fit.importance().collect()
    assert len(importance) == 20 and all(r["feature"] != str(i) for i, r in enumerate(importance))
    names = {r["feature"] for r in fit.importance(1000).collect()}
    assert "store_level" in names and "lag_7" in names
    without = M.forest_features(df, use_lags=False)
    assert "lag_7" not in without.columns


def test_fits_travel_without_the_package():
    """The workers may not have this package, so nothing sent to them may refer to it."""
    for sent in (M._seasonal(DEFAULTS), regression.solve, M._last_part(DEFAULTS)):
        code = "import pickle, sys; pickle.load(sys.stdin.buffer); print([m for m in sys.modules if m.startswith('larder')])"
        done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(sent), capture_output=True, cwd="/")
        assert done.stdout.decode().strip() == "[]", done.stderr.decode()
