"""Price elasticity, discounts and competitor prices.

G7-G14 also accept the sums of `price_sums` in place of the fact; G4, G5, G15 and G16 accept
a table that `product_elasticity` has returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import (
    category_price_action, net_revenue, price_bucket_label, price_bucket_labels, price_bucket_no,
    price_difference_pct, product_price_action,
)
from larder.functions.nulls import known
from larder.functions.quantiles import exact_quantiles
from larder.functions.ranking import best_per_group, largest, ranked
from larder.functions.sums import mean, summed
from larder.params import DEFAULTS, Params
from larder.session import durable

MIN_POINTS = 3


def _points(df: DataFrame, key: str) -> DataFrame:
    return known(df, key, "price").groupBy(key, "price").agg(F.avg("units_sold").alias("avg_units"))


def _usable() -> Column:
    return (F.col("price") > 0) & (F.col("avg_units") > 0)


def price_points(df: DataFrame, key: str = "product_id") -> DataFrame:
    """G1: mean units per exact price, for products with at least three usable prices.

    The points per product are counted by an aggregate and joined back, so the prices of
    one product are never gathered in one task.
    """
    points = _points(df, key)
    enough = points.groupBy(key).agg(F.count_if(_usable()).alias("n")).where(F.col("n") >= MIN_POINTS)
    return points.where(_usable()).join(enough.select(key), key, "left_semi")


def _fits(df: DataFrame, key: str) -> DataFrame:
    """Log-log line, price range and number of usable points per product, as one aggregate."""
    if "elasticity" in df.columns:
        return df
    points = _points(df, key).where(_usable()).withColumns({"x": F.log("price"), "y": F.log("avg_units")})
    return points.groupBy(key).agg(
        F.count("*").alias("n_points"),
        F.regr_slope("y", "x").alias("elasticity"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.avg("price").alias("avg_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    ).where((F.col("n_points") >= MIN_POINTS) & F.col("elasticity").isNotNull())


def product_category(df: DataFrame, key: str = "product_id") -> DataFrame:
    """The first category seen: earliest day, then smallest store, then name.

    The first step keeps only dates per (product, category, store), which a hash
    aggregate merges before the shuffle.
    """
    seen = known(df, key, "category").groupBy(key, "category", "store_id").agg(F.min("date").alias("date"))
    return seen.groupBy(key).agg(F.min(F.struct("date", "store_id", "category"))["category"].alias("category"))


def product_elasticity(df: DataFrame, key: str = "product_id", params: Params = DEFAULTS) -> DataFrame:
    """Slope of ln(units) on ln(price) over the price points of each product."""
    if "elastic_status" in df.columns:
        return df
    fits = _fits(df, key).select(key, "elasticity", "avg_price", "n_points")
    status = F.when(F.col("elasticity") < params.elasticity_threshold, "Elastic").otherwise("Inelastic")
    return fits.withColumn("elastic_status", status).join(product_category(df, key), key, "left")


def category_elasticity(df: DataFrame, key: str = "product_id") -> DataFrame:
    """Median slope of the products of each category.

    The slopes are written once: a slope found again may differ in its last digits with the order in which partial
    sums meet, and the passes of the median must see the same values.
    """
    slopes = durable(product_elasticity(df, key).select("category", "elasticity"), "slopes")
    medians = exact_quantiles(slopes, "elasticity", [0.5], ["category"])
    slope = F.get("quantiles", F.lit(0))
    return medians.select(
        "category", slope.alias("elasticity"),
        F.when(F.abs(slope) > 1, "Elastic").otherwise("Inelastic").alias("elastic_status"),
        F.col("n").alias("n_products"),
    )


def elasticity_summary(df: DataFrame, key: str = "product_id", params: Params = DEFAULTS) -> DataFrame:
    """G5."""
    elastic = F.col("elasticity") < params.elasticity_threshold
    return _fits(df, key).agg(
        F.count("*").alias("n_products"), F.count_if(elastic).alias("n_elastic"), F.count_if(~elastic).alias("n_inelastic")
    )


def elasticity_curve(df: DataFrame, key: str = "product_id", steps: int = 100) -> DataFrame:
    """Fitted units at evenly spaced prices."""
    grid = _fits(df, key).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    price = F.col("min_price") + F.col("step") * ((F.col("max_price") - F.col("min_price")) / (steps - 1))
    return grid.withColumn("price", price).select(
        key, "step", "price", F.exp(F.col("intercept") + F.col("elasticity") * F.log("price")).alias("fitted_units")
    )


def price_sums(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Sums of units and revenue by category, discount and price bucket."""
    keys = ["category", "discount", "bucket_no"]
    return summed(_bucketed(df, params), keys, units_sold=F.col("units_sold"), revenue=net_revenue())


def _revenue(df: DataFrame) -> Column:
    return mean(df, "revenue", net_revenue())


def discount_units(df: DataFrame) -> DataFrame:
    """G7."""
    return known(df, "discount").groupBy("discount").agg(mean(df, "units_sold").alias("avg_units"))


def discount_revenue(df: DataFrame) -> DataFrame:
    """G8."""
    return known(df, "discount").groupBy("discount").agg(_revenue(df).alias("avg_revenue"))


def optimal_discount(df: DataFrame) -> DataFrame:
    """G9."""
    return largest(discount_revenue(df), "avg_revenue", 1, "discount")


def category_discount_revenue(df: DataFrame) -> DataFrame:
    """Mean revenue by category and discount."""
    return known(df, "category", "discount").groupBy("category", "discount").agg(_revenue(df).alias("avg_revenue"))


def category_optimal_discount(df: DataFrame) -> DataFrame:
    """The best discount of each category."""
    return best_per_group(category_discount_revenue(df), "category", "avg_revenue", "discount")


def _bucketed(df: DataFrame, params: Params) -> DataFrame:
    if "bucket_no" in df.columns:
        return df
    return df.withColumn("bucket_no", price_bucket_no(price_difference_pct(), params))


def _every_bucket(means: DataFrame, value: str, params: Params) -> DataFrame:
    """Means on the full list of buckets; the list has one row per label."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("bucket_no"), F.lit(label).alias("bucket"))
        for i, label in enumerate(price_bucket_labels(params.price_diff_bins))
    ])
    spine = means.sparkSession.range(1).select(F.inline(rows))
    return spine.join(means, "bucket_no", "left").select("bucket_no", "bucket", value)


def bucket_units(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """G11."""
    means = known(_bucketed(df, params), "bucket_no").groupBy("bucket_no").agg(mean(df, "units_sold").alias("avg_units"))
    return _every_bucket(means, "avg_units", params)


def bucket_revenue(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """G12."""
    means = known(_bucketed(df, params), "bucket_no").groupBy("bucket_no").agg(_revenue(df).alias("avg_revenue"))
    return _every_bucket(means, "avg_revenue", params)


def optimal_price_position(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """G13."""
    return largest(bucket_revenue(df, params), "avg_revenue", 1, "bucket_no")


def category_bucket_revenue(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Mean revenue by category and bucket."""
    placed = known(_bucketed(df, params), "category", "bucket_no")
    means = placed.groupBy("category", "bucket_no").agg(_revenue(df).alias("avg_revenue"))
    return means.withColumn("bucket", price_bucket_label(F.col("bucket_no"), params))


def category_price_position(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The best bucket of each category."""
    return best_per_group(category_bucket_revenue(df, params), "category", "avg_revenue", "bucket_no").drop("bucket_no")


def category_price_recommendations(df: DataFrame, key: str = "product_id") -> DataFrame:
    """G15."""
    return category_elasticity(df, key).select("category", "elasticity", category_price_action(F.col("elasticity")).alias("recommendation"))


def product_price_recommendations(df: DataFrame, key: str = "product_id", n: int = 5) -> DataFrame:
    """The n smallest and the n largest slopes with their advice."""
    fits = _fits(df, key).select(key, "elasticity", "avg_price")
    both = ranked(fits, "most_elastic", "elasticity", n, True, key).unionByName(
        ranked(fits, "least_elastic", "elasticity", n, False, key)
    )
    return both.withColumn("recommendation", product_price_action(F.col("elasticity"), F.col("avg_price")))
