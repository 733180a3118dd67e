"""Dashboard tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.nulls import known
from larder.functions.ranking import largest
from larder.operators.filters import Slice, filter_slice
from larder.operators.forecast import daily_totals

EVERYTHING = Slice()


def kpis(df: DataFrame, chosen: Slice = EVERYTHING) -> DataFrame:
    """Units, mean inventory, 100 minus the weighted error percent, inventory turn."""
    error = F.avg(F.abs(F.col("units_sold") - F.col("demand_forecast")))
    totals = filter_slice(df, chosen).agg(
        F.sum("units_sold").alias("total_sales"),
        F.avg("inventory_level").alias("avg_inventory"),
        (100 - 100 * error / F.nullif(F.avg("units_sold"), F.lit(0.0))).alias("forecast_accuracy_pct"),
    )
    turn = F.col("total_sales") / F.nullif(F.col("avg_inventory"), F.lit(0.0))
    return totals.withColumn("inventory_turn", F.coalesce(turn, F.lit(0.0)))


def sales_trend(df: DataFrame, chosen: Slice = EVERYTHING) -> DataFrame:
    """D2."""
    return daily_totals(filter_slice(df, chosen))


def sales_by_category(df: DataFrame, chosen: Slice = EVERYTHING) -> DataFrame:
    """D3: all categories, whatever the category filter says."""
    rows = filter_slice(df, replace(chosen, categories=()))
    return known(rows, "category").groupBy("category").agg(F.sum("units_sold").alias("units_sold"))


def top_products_table(df: DataFrame, chosen: Slice = EVERYTHING, n: int = 10) -> DataFrame:
    """The product filter is ignored here."""
    rows = known(filter_slice(df, replace(chosen, products=())), "product_id", "category")
    products = rows.groupBy("product_id", "category").agg(
        F.sum("units_sold").alias("units_sold"),
        F.bround(F.avg("inventory_level"), 1).alias("avg_inventory"),
        F.bround(F.avg("price"), 2).alias("avg_price"),
        F.bround(F.avg("discount"), 2).alias("avg_discount"),
    )
    return largest(products, "units_sold", n, "product_id", "category")


def inventory_vs_sales(df: DataFrame, chosen: Slice = EVERYTHING) -> DataFrame:
    """Both sides of the chart from one aggregate instead of a join on the day."""
    return known(filter_slice(df, chosen), "date").groupBy("date").agg(
        F.avg("inventory_level").alias("avg_inventory"), F.sum("units_sold").alias("units_sold")
    )


def overview_cards(df: DataFrame) -> DataFrame:
    """Products, stores, units and the inventory of the last day.

    Inventory is summed per day first; the last day is then the largest of few rows.
    """
    per_day = known(df, "date").groupBy("date").agg(F.sum("inventory_level").alias("inventory"))
    last = per_day.agg(F.max(F.struct("date", "inventory"))["inventory"])
    return df.agg(
        F.count_distinct("product_id").alias("n_products"),
        F.count_distinct("store_id").alias("n_stores"),
        F.sum("units_sold").alias("units_sold"),
    ).withColumn("current_inventory", last.scalar())


def data_overview(df: DataFrame) -> DataFrame:
    """Period, numbers of stores and products, and one row per category and region."""
    head = df.agg(
        F.min("date").cast("string").alias("period_start"),
        F.max("date").cast("string").alias("period_end"),
        F.count_distinct("store_id").cast("string").alias("n_stores"),
        F.count_distinct("product_id").cast("string").alias("n_products"),
    )
    lists = df.select("category", "region").distinct().unpivot([], ["category", "region"], "item", "value")
    items = head.unpivot([], list(head.columns), "item", "value")
    return items.unionByName(lists.where(F.col("value").isNotNull()).distinct())
