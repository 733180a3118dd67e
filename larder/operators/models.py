"""Fitted forecasts.

The seasonal fit runs as grouped tasks over daily sums: a group holds at most one row per calendar
day, however large the fact is. The regression needs sums of products only. The forest splits its large nodes by sums
over all rows and grows the others over their own rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import forest, regression, seasonal_ar
from larder.functions.seasonal_ar import Orders, fit_seasonal_ar
from larder.operators.filters import drop_incomplete
from larder.operators.forecast import (
    LAGS, SERIES, WINDOWS, lag_features, rolling_features, store_day_features, store_day_split,
)
from larder.params import DEFAULTS, Params
from larder.session import durable

# The fit functions travel with the job, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(seasonal_ar)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORECAST_SCHEMA = (
    "kind string, series_id string, ds date, y double, predicted double, lower double, upper double, error string, "
    "converged boolean"
)
Fit = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, bool]]


def _seasonal(params: Params) -> Fit:
    orders = Orders(tuple(params.order), tuple(params.seasonal_order))  # raises here, before any job, if unsupported
    min_rows, max_steps = params.min_fit_days, params.max_fit_steps

    def fit(days, y, future):
        found = fit_seasonal_ar(y, orders, min_rows, max_steps)
        mean, spread = seasonal_ar.forecast(y, found, len(future))
        return mean, mean - spread, mean + spread, found.converged
    return fit


def _forecast(panel: DataFrame, fit: Fit, horizon: int, holdout: Callable[[int], int] | None) -> DataFrame:
    """Forecast each series; with a holdout, its last rows are predicted instead of the future."""

    def one_series(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ds")
        days = pd.to_datetime(rows["ds"]).to_numpy().astype("datetime64[D]").astype(int)
        y = rows["y"].to_numpy(dtype=float)
        base = {"kind": rows["kind"].iloc[0], "series_id": rows["series_id"].iloc[0]}
        try:
            if holdout:
                train = len(y) - holdout(len(y))
                future, actual = days[train:], y[train:]
                days, y = days[:train], y[:train]
            else:
                future, actual = days[-1] + 1 + np.arange(horizon), np.full(horizon, np.nan)
            mean, lower, upper, converged = fit(days, y, future)
        except (ValueError, IndexError, np.linalg.LinAlgError) as problem:
            failed = dict(base, ds=None, y=None, predicted=None, lower=None, upper=None, error=str(problem),
                          converged=None)
            return pd.DataFrame([failed])
        dates = pd.Series(future.astype("datetime64[D]")).dt.date
        return pd.DataFrame(dict(base, ds=dates, y=actual, predicted=mean, lower=lower, upper=upper, error=None,
                                 converged=converged))

    result = panel.groupBy(*SERIES).applyInPandas(one_series, FORECAST_SCHEMA)
    return result.withColumn("y", F.nanvl("y", F.lit(None).cast("double")))


def _last_part(params: Params) -> Callable[[int], int]:
    fraction = params.train_fraction  # a plain number travels to the workers
    return lambda n: n - int(n * fraction)


def seasonal_forecast(panel: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """the next days of each series with 95 % bounds, fitted on all of it, by the orders of `params`.

    A series too short for them, or that the fit fails for, becomes one row with an error; `converged` tells of the others
    whether the fit came to rest within `max_fit_steps`.
    """
    return _forecast(panel, _seasonal(params), params.forecast_horizon_days, None).drop("y")


def seasonal_holdout(panel: DataFrame, params: Params = DEFAULTS, last_days: int | None = None) -> DataFrame:
    """predictions for the last part of each series, fitted on the first."""
    held = (lambda n: last_days) if last_days else _last_part(params)
    return _forecast(panel, _seasonal(params), 0, held)


def regression_series(panel: DataFrame) -> DataFrame:
    """the total and every category."""
    return panel.where(F.col("kind").isin("total", "category"))


def regression_weights(train: DataFrame) -> DataFrame:
    """per series n days and the weights of its terms, by least squares on ln(y + 1)."""
    return regression.with_weights(regression.sums_of_products(train, SERIES))


def _regressed(days: DataFrame, weights: DataFrame, params: Params) -> DataFrame:
    """The named days (kind, series_id, ds, y) with their predictions; a series with few days becomes one row with an error."""
    few = F.col("n") < params.min_fit_days
    columns = regression.predictions(F.col("ds"), F.col("weights"))
    scored = days.join(weights.where(~few), [*SERIES]).withColumns({**columns, "error": F.lit(None).cast("string")})
    none = {c: F.lit(None).cast(t) for c, t in (("ds", "date"), ("y", "double"), ("predicted", "double"),
                                                ("lower", "double"), ("upper", "double"))}
    problem = F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(" days"))
    failed = weights.where(few).withColumns({**none, "error": problem})
    names = [*SERIES, "ds", "y", "predicted", "lower", "upper", "error"]
    return scored.select(names).unionByName(failed.select(names))


def regression_forecast(panel: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """the next days from trend, weekday and yearly terms. A series without any y above -1 has no row."""
    last = panel.groupBy(*SERIES).agg(F.max("ds").alias("last"))
    ahead = F.sequence(F.date_add("last", 1), F.date_add("last", params.forecast_horizon_days))
    future = last.select(*SERIES, F.explode(ahead).alias("ds"), F.lit(None).cast("double").alias("y"))
    return _regressed(future, regression_weights(panel), params).drop("y")


def regression_holdout(panel: DataFrame, params: Params = DEFAULTS, last_days: int | None = None) -> DataFrame:
    """predictions for the last part of each series, fitted on the first."""
    place = F.row_number().over(Window.partitionBy(*SERIES).orderBy("ds"))  # one row per calendar day
    size = F.count("*").over(Window.partitionBy(*SERIES))
    trained = size - last_days if last_days else F.floor(size * F.lit(params.train_fraction))
    rows = panel.select(*SERIES, "ds", "y", (place <= trained).alias("known"))
    return _regressed(rows.where(~F.col("known")).drop("known"), regression_weights(rows.where("known")), params)


@dataclass(frozen=True)
class ForestFit:
    model: Forest
    features: DataFrame

    def predictions(self) -> DataFrame:
        """the test rows with their prediction."""
        test = self.features.where(F.col("split") == "test")
        scored = self.model.transform(test)
        return scored.select("date", "store_id", F.col("units_sold").cast("double").alias("y"),
                             F.col("prediction").alias("predicted"))

    def importance(self, n: int = 20) -> DataFrame:
        """the n most important features; the model holds one number per feature."""
        rows = [(name, float(w)) for name, w in zip(self.model.inputs.columns(), self.model.importances(), strict=True)]
        spark = self.features.sparkSession
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


ROWS_PER_PARTITION = 100_000


def training_partitions(rows: int) -> int:
    """Partitions of a training table, by its rows alone.

    A tree draws its rows by their place in the partitions, so their number follows from the data and never from the
    cluster or its settings.
    """
    return max(-(-rows // ROWS_PER_PARTITION), 1)


def forest_features(df: DataFrame, use_lags: bool = True, params: Params = DEFAULTS) -> DataFrame:
    """store-day rows with lags, without incomplete rows, split in time order."""
    daily = with_store_level(store_day_features(df))
    if use_lags:
        daily = rolling_features(lag_features(daily))
    return store_day_split(drop_incomplete(daily), params)


def with_store_level(daily: DataFrame) -> DataFrame:
    """A store's mean sales over all its earlier days: one number for any number of stores, from the past only."""
    earlier = Window.partitionBy("store_id").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return daily.withColumn("store_level", F.coalesce(F.avg("units_sold").over(earlier), F.lit(0.0)))


@dataclass(frozen=True)
class Inputs:
    """The features of a row: its numbers, and of each text column which of the known labels it has, or that it has none of them."""

    numbers: tuple[str, ...]
    labels: dict[str, tuple[str, ...]]

    def columns(self) -> dict[str, Column]:
        """By name, in the order in which the trees ask for them."""
        out = {n: F.col(n).cast("double") for n in self.numbers}
        for text, labels in self.labels.items():
            has = {x: F.coalesce(F.col(text) == x, F.lit(False)) for x in labels}
            out |= {f"{text}_is_{x}": is_x.cast("double") for x, is_x in has.items()}
            out[f"{text}_is___unknown"] = (~F.coalesce(F.col(text).isin(*labels), F.lit(False))).cast("double")
        return out


@dataclass(frozen=True)
class Forest:
    """`inputs` makes the features, `trees` are the trained trees."""

    inputs: Inputs
    trees: forest.Trees

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with `prediction`, the mean over all trees."""
        return df.withColumn("prediction", self.trees.predictor(df)(F.array(*self.inputs.columns().values())))

    def importances(self) -> np.ndarray:
        """The mean over all trees, one number per feature."""
        return self.trees.importances()


def fit_forest(train: DataFrame, label: str, numbers: Sequence[str], texts: Sequence[str], params: Params,
               parts: int, order: Sequence[str]) -> Forest:
    """All trees over all features. The rows are dealt to `parts` partitions by `order` and sorted by it there, which fixes
    the draws of each tree."""
    labels = {t: tuple(sorted(r[t] for r in train.where(F.col(t).isNotNull()).select(t).distinct().collect())) for t in texts}
    inputs = Inputs(tuple(numbers), labels)
    limits = forest.Limits(params.max_depth, (params.min_samples_split + 1) // 2, params.seed)
    rows = train.repartition(parts, *order).sortWithinPartitions(*order)
    return Forest(inputs, forest.train(rows, label, [*inputs.columns().values()], params.trees, limits))


def random_forest_forecast(df: DataFrame, params: Params = DEFAULTS, use_lags: bool = True) -> ForestFit:
    """a forest over store-day features.

    The rows are written once to the shared folder. Training deals them by hash into `training_partitions` and sorts them
    by (date, store) there: the same rows give the same forest on any cluster. A store enters as its mean sales of
    earlier days.
    """
    features = forest_features(df, use_lags, params)  # written by the split
    parts = training_partitions(features.count())
    numbers = ["avg_inventory", "avg_price", "avg_discount", "avg_competitor", "holiday_promotion",
               "month", "year", "day", "weekday", "week", "store_level"]
    if use_lags:
        numbers += [f"lag_{k}" for k in LAGS] + [f"rolling_{w}" for w in WINDOWS]
    train = features.where(F.col("split") == "train")
    return ForestFit(fit_forest(train, "units_sold", numbers, ["weather"], params, parts, ("date", "store_id")), features)


CALENDAR = {"month": F.month, "year": F.year, "day": F.dayofmonth, "weekday": F.weekday, "week": F.weekofyear}


def forest_holdout(panel: DataFrame, params: Params = DEFAULTS, last_days: int = 30) -> DataFrame:
    """a forest over lags and calendar of each series, fitted before one cut, and every day after it predicted from
    earlier predictions. kind, series_id, ds, y, predicted of the last days; their y take part in nothing.

    The state of a series is its last 28 values, so a step is a projection; lineage is cut every six steps.
    """
    place = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("ds")))
    rows = durable(panel.withColumn("from_end", place), "forest_panel")
    past = rows.where(F.col("from_end") > last_days).withColumn("key", F.struct(*SERIES))
    renamed = past.select("key", F.col("ds").alias("date"), F.col("y").alias("units_sold"))
    numbers = [*CALENDAR, *[f"lag_{k}" for k in LAGS], *[f"rolling_{w}" for w in WINDOWS]]
    train = rolling_features(lag_features(renamed, "key"), "key").withColumns({c: make("date") for c, make in CALENDAR.items()})
    complete = durable(drop_incomplete(train.select("date", "units_sold", "key", *numbers)), "forest_days")
    parts = training_partitions(complete.count())
    model = fit_forest(complete, "units_sold", numbers, [], params, parts, ("date", "key"))

    longest = max(*LAGS, *WINDOWS)
    recent = past.where(F.col("from_end") <= last_days + longest).groupBy(*SERIES).agg(
        F.sort_array(F.collect_list(F.struct("ds", "y")))["y"].alias("recent"))  # that many days
    future = rows.where(F.col("from_end") <= last_days).groupBy(*SERIES).agg(F.sort_array(F.collect_list("ds")).alias("days"))
    empty = F.array().cast("array<double>")
    state = durable(recent.where(F.size("recent") == longest).join(future, [*SERIES]).withColumn("path", empty), "forest_state")
    for step in range(last_days):
        values = {c: make(F.get("days", F.lit(step))) for c, make in CALENDAR.items()}
        values |= {f"lag_{k}": F.element_at("recent", -k) for k in LAGS}
        values |= {f"rolling_{w}": F.aggregate(F.slice("recent", -w, w), F.lit(0.0), lambda n, x: n + x) / w for w in WINDOWS}
        scored = model.transform(state.withColumns(values))
        state = scored.select(
            *SERIES, "days", F.concat("path", F.array("prediction")).alias("path"),
            F.concat(F.slice("recent", 2, longest - 1), F.array("prediction")).alias("recent"))
        if step % 6 == 5:
            state = durable(state, "forest_state")
    predicted = state.select(*SERIES, F.inline(F.arrays_zip(F.col("days").alias("ds"), F.col("path").alias("predicted"))))
    return rows.where(F.col("from_end") <= last_days).join(predicted, [*SERIES, "ds"]).select(*SERIES, "ds", "y", "predicted")
