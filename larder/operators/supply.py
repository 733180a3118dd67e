"""Supply analysis.

Y4-Y6 and Y13 also accept a table that `product_supply_metrics` has returned, so that a
batch of them reads the fact once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import forecast_accuracy, inventory_sales_ratio, supply_gap, supply_status
from larder.functions.nulls import known
from larder.functions.quantiles import quantile
from larder.functions.ranking import largest, ranked, smallest
from larder.params import DEFAULTS, Params
from larder.session import durable
from larder.schema import STATUSES


def _mode_of_status() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(f"_{s}") for s in STATUSES]


def _pick_mode() -> Column:
    """The most frequent status; the alphabetically first one on a tie."""
    most = F.greatest(*[F.col(f"_{s}") for s in STATUSES])
    return F.coalesce(*[F.when(F.col(f"_{s}") == most, F.lit(s)) for s in sorted(STATUSES)])


def _with_mode(grouped: DataFrame) -> DataFrame:
    return grouped.withColumn("supply_status", _pick_mode()).drop(*[f"_{s}" for s in STATUSES])


def supply_status_counts(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Rows and percent per status; the share window sees at most four rows."""
    counts = df.groupBy(supply_status(params).alias("supply_status")).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("pct", F.col("n") * 100.0 / whole)


def status_by(df: DataFrame, key: str, params: Params = DEFAULTS) -> DataFrame:
    """Rows and row percent by key and status; statuses seen nowhere are left out.

    One hash aggregate holds the counts of all statuses of a key side by side.
    """
    marked = known(df, key).withColumn("status", supply_status(params))
    wide = marked.groupBy(key).agg(F.count("*").alias("total"), *_mode_of_status())
    cells = F.array(*[F.struct(F.lit(s).alias("supply_status"), F.col(f"_{s}").alias("n")) for s in STATUSES])
    long = wide.select(key, "total", F.inline(cells)).withColumn("pct", F.col("n") * 100.0 / F.col("total"))
    unknown_only_if_seen = (F.col("supply_status") != "Unknown") | (F.col("n") > 0)
    return long.where(unknown_only_if_seen).drop("total")


def status_pivot(df: DataFrame, key: str, params: Params = DEFAULTS) -> DataFrame:
    """Y2 as a cross table with one column per status."""
    marked = known(df, key).withColumn("status", supply_status(params))
    return marked.groupBy(key).pivot("status", list(STATUSES)).count().na.fill(0)


def product_supply_metrics(df: DataFrame, *keys: str, params: Params = DEFAULTS) -> DataFrame:
    """Status, gap, units, inventory, accuracy and ratio by product and category (or given keys)."""
    if "avg_gap" in df.columns:
        return df
    keys = keys or ("product_id", "category")
    marked = known(df, *keys).withColumn("status", supply_status(params))
    grouped = marked.groupBy(*keys).agg(
        F.avg(supply_gap()).alias("avg_gap"),
        F.sum("units_sold").alias("units_sold"),
        F.avg("inventory_level").alias("avg_inventory"),
        F.avg(forecast_accuracy()).alias("avg_accuracy"),
        F.avg(inventory_sales_ratio()).alias("avg_ratio"),
        *_mode_of_status(),
    )
    return _with_mode(grouped)


def critical_undersupply(df: DataFrame, n: int = 10, params: Params = DEFAULTS) -> DataFrame:
    """Undersupplied products that sell above their median, smallest gaps first."""
    under = durable(product_supply_metrics(df, params=params).where(F.col("supply_status") == "Undersupplied").drop("avg_ratio"))
    busy = under.where(F.col("units_sold") > F.lit(quantile(under, "units_sold", 0.5)).cast("double"))
    return smallest(busy, "avg_gap", n, "product_id", "category")


def excessive_oversupply(df: DataFrame, n: int = 10, params: Params = DEFAULTS) -> DataFrame:
    """Oversupplied products with a gap above their 90 % quantile, largest first."""
    over = durable(product_supply_metrics(df, params=params).where(F.col("supply_status") == "Oversupplied").drop("avg_ratio"))
    wide = over.where(F.col("avg_gap") > F.lit(quantile(over, "avg_gap", 0.9)).cast("double"))
    return largest(wide, "avg_gap", n, "product_id", "category")


def store_supply_metrics(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Y7."""
    return product_supply_metrics(df, "store_id", params=params).select(
        "store_id", "supply_status", "avg_ratio", "avg_gap", "avg_accuracy"
    )


def supply_overall(df: DataFrame) -> DataFrame:
    """Y8."""
    return df.agg(
        F.avg(inventory_sales_ratio()).alias("avg_ratio"),
        F.avg(supply_gap()).alias("avg_gap"),
        F.avg(forecast_accuracy()).alias("avg_accuracy"),
    )


def category_gap_extremes(df: DataFrame) -> DataFrame:
    """Categories with the smallest and the largest mean gap."""
    gaps = known(df, "category").groupBy("category").agg(F.avg(supply_gap()).alias("avg_gap"))
    low = smallest(gaps, "avg_gap", 1, "category").withColumn("item", F.lit("most_undersupplied"))
    high = largest(gaps, "avg_gap", 1, "category").withColumn("item", F.lit("most_oversupplied"))
    return low.unionByName(high)


def category_supply_metrics(df: DataFrame) -> DataFrame:
    """Y10."""
    return known(df, "category").groupBy("category").agg(
        F.avg(inventory_sales_ratio()).alias("avg_ratio"),
        F.avg(supply_gap()).alias("avg_gap"),
        F.avg(forecast_accuracy()).alias("avg_accuracy"),
    )


def product_supply_rankings(df: DataFrame, n: int = 10, params: Params = DEFAULTS) -> DataFrame:
    """Four top-n lists over one product table, whose shuffle Spark reuses."""
    products = product_supply_metrics(df, "product_id", params=params)
    lists = [
        ranked(products, "most_sold", "units_sold", n, False, "product_id"),
        ranked(products, "most_undersupplied", "avg_gap", n, True, "product_id"),
        ranked(products, "most_oversupplied", "avg_gap", n, False, "product_id"),
        ranked(products, "worst_forecast", "avg_accuracy", n, True, "product_id"),
    ]
    return reduce(DataFrame.unionByName, lists)


def store_sums(df: DataFrame) -> DataFrame:
    """Units and inventory by store."""
    return known(df, "store_id").groupBy("store_id").agg(
        F.sum("units_sold").alias("units_sold"), F.sum("inventory_level").alias("inventory_level")
    )


def poor_forecast_products(df: DataFrame, n: int = 5) -> DataFrame:
    """Products and categories with the smallest accuracy."""
    accuracy = product_supply_metrics(df).select("product_id", "category", "avg_accuracy")
    return smallest(accuracy, "avg_accuracy", n, "product_id", "category")
