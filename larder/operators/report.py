"""Figures of the final report."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import (
    forecast_accuracy, net_revenue, price_bucket_label, price_bucket_no, price_difference_pct, supply_gap, supply_status,
)
from larder.operators.pricing import elasticity_summary
from larder.params import DEFAULTS, Params


def key_metrics(df: DataFrame, scores: DataFrame, params: Params = DEFAULTS, model: str = "forecast_model_r2") -> DataFrame:
    """(metric, value) rows; scores is a one-row result with the r2 of what `model` names."""
    supply = df.agg(
        (F.avg((supply_status(params) == "Optimal").cast("double")) * 100).alias("optimal_inventory_pct"),
        F.avg(supply_gap()).alias("avg_supply_gap"),
        F.avg(forecast_accuracy()).alias("avg_forecast_accuracy"),
    )
    fitted = scores.select(F.col("r2").alias(model))
    prices = elasticity_summary(df, params=params).select(
        F.col("n_products").cast("double").alias("products_analyzed"),
        F.col("n_inelastic").cast("double").alias("inelastic_products"),
    )
    return reduce(DataFrame.unionByName, [
        part.unpivot([], list(part.columns), "metric", "value") for part in (supply, fitted, prices)
    ])


def key_insights(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """R2: (insight, answer) rows from one pass over the fact.

    Grouping sets give the means of all five questions together; each answer is then the
    first row of its set, picked by one small aggregate.
    """
    keys = ["seasonality", "region", "category", "discount", "bucket_no"]
    rows = df.select(
        *keys[:-1], price_bucket_no(price_difference_pct(), params).alias("bucket_no"), "units_sold",
        forecast_accuracy().alias("accuracy"), net_revenue().alias("revenue"),
    )
    sets = [["seasonality"], ["seasonality", "region"], ["category"], ["discount"], ["bucket_no"]]
    means = rows.groupingSets(sets, *keys).agg(
        F.avg("units_sold").alias("avg_units"), F.sum("units_sold").alias("units"), F.avg("accuracy").alias("accuracy"),
        F.avg("revenue").alias("revenue"), *[F.grouping(k).alias(f"_{k}") for k in keys],
    )

    def first(order: Column, *used: str, where: Column | None = None) -> Column:
        """The last used key of the row that comes first; ties go to the smaller key."""
        rule = [F.col(f"_{k}") == (0 if k in used else 1) for k in keys]
        rule += [order.isNotNull(), *[F.col(k).isNotNull() for k in used], *([] if where is None else [where])]
        return F.min(F.when(reduce(and_, rule), F.struct(order.alias("order"), used[-1])))[used[-1]]

    answers = means.agg(
        first(-F.col("avg_units"), "seasonality").alias("peak_season"),
        first(-F.col("units"), "seasonality", "region", where=F.col("seasonality") == "Autumn").alias("best_autumn_region"),
        first(F.col("accuracy"), "category").alias("worst_forecast_category"),
        first(-F.col("revenue"), "discount").cast("string").alias("optimal_discount"),
        price_bucket_label(first(-F.col("revenue"), "bucket_no"), params).alias("optimal_price_position"),
    )
    return answers.unpivot([], list(answers.columns), "insight", "answer")
