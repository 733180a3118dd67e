"""Inventory optimisation."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.nulls import known
from larder.functions.ranking import largest, top_per_group
from larder.params import DEFAULTS, Params

KEYS = ("product_id", "store_id")
DAYS_PER_YEAR = 365


def demand_stats(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Demand and unit cost by product and store."""
    return known(df, *keys).groupBy(*keys).agg(
        F.avg("units_sold").alias("demand_mean"),
        F.stddev_samp("units_sold").alias("demand_std"),
        F.sum("units_sold").cast("double").alias("annual_demand"),
        F.avg("price").alias("unit_cost"),
    )


def annualised_demand(stats: DataFrame, df: DataFrame, always: bool = False) -> DataFrame:
    """Scale sums to a year when the data covers less than one (or always)."""
    days = df.agg(F.datediff(F.max("date"), F.min("date")) + 1).scalar()
    factor = F.lit(float(DAYS_PER_YEAR)) / days
    scaled = factor if always else F.when(days < DAYS_PER_YEAR, factor).otherwise(1.0)
    return stats.withColumn("annual_demand", F.col("annual_demand") * scaled)


def safety_stock(demand_std: Column, lead_time: float, service_level: float = 0.95) -> Column:
    """Z * std * sqrt(lead time)."""
    return F.lit(NormalDist().inv_cdf(service_level)) * demand_std * F.sqrt(F.lit(float(lead_time)))


def reorder_point(demand_mean: Column, demand_std: Column, lead_time: float, service_level: float = 0.95) -> Column:
    """Demand during the lead time plus the safety stock."""
    return demand_mean * float(lead_time) + safety_stock(demand_std, lead_time, service_level)


def eoq(annual_demand: Column, ordering_cost: float, holding_cost_pct: float, unit_cost: Column) -> Column:
    """sqrt(2 D S / (c h))."""
    return F.sqrt(2 * annual_demand * float(ordering_cost) / F.nullif(unit_cost * holding_cost_pct, F.lit(0.0)))


def unrounded_params(df: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = KEYS, always: bool = False) -> DataFrame:
    """N1-N5 side by side."""
    lead, level = params.lead_time_days, params.service_level
    mean, std = F.col("demand_mean"), F.col("demand_std")
    return annualised_demand(demand_stats(df, keys), df, always).withColumns({
        "safety_stock": safety_stock(std, lead, level),
        "reorder_point": reorder_point(mean, std, lead, level),
        "eoq": eoq(F.col("annual_demand"), params.ordering_cost, params.holding_cost_pct, F.col("unit_cost")),
    })


def inventory_params(df: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = KEYS, always: bool = False) -> DataFrame:
    """The three stock figures as whole units, halves to even."""
    return unrounded_params(df, params, keys, always).withColumns({
        c: F.bround(c).cast("long") for c in ("safety_stock", "reorder_point", "eoq")
    })


def product_inventory_params(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Sums over stores of the rounded figures (deviations are summed too) and the mean cost."""
    summed = ("demand_mean", "demand_std", "annual_demand", "safety_stock", "reorder_point", "eoq")
    return inventory_params(df, params).groupBy("product_id").agg(
        *[F.sum(c).alias(c) for c in summed], F.avg("unit_cost").alias("unit_cost")
    )


def top_inventory_products(df: DataFrame, n: int = 10, params: Params = DEFAULTS) -> DataFrame:
    """N8."""
    return largest(product_inventory_params(df, params), "annual_demand", n, "product_id")


def store_top_products(df: DataFrame, n: int = 5, params: Params = DEFAULTS) -> DataFrame:
    """N9."""
    order = [F.desc("annual_demand"), F.col("product_id")]
    best = top_per_group(inventory_params(df, params), ["store_id"], order, n)
    return best.select("store_id", "rank", "product_id", "annual_demand", "safety_stock", "reorder_point", "eoq")


def inventory_lookup(df: DataFrame, product_id: str, params: Params = DEFAULTS) -> DataFrame:
    """One product's figures; the days covered still come from the whole table."""
    return product_inventory_params(df, params).where(F.col("product_id") == product_id)
