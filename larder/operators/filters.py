"""Filters, key filters and limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import forecast_accuracy, supply_status
from larder.functions.quantiles import quantile
from larder.functions.ranking import largest
from larder.params import DEFAULTS, Params


@dataclass(frozen=True)
class Slice:
    """A dashboard selection; an empty field selects everything."""

    start: str | None = None
    end: str | None = None
    categories: tuple[str, ...] = ()
    stores: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    products: tuple[str, ...] = ()


def filter_slice(df: DataFrame, chosen: Slice) -> DataFrame:
    """Plain predicates, which Spark moves into the scan; dates are inclusive.

    Of a table that keeps its `month_start`, only the folders of the months in question are listed and read.
    """
    if "month_start" in df.columns:
        for day, name in ((chosen.start, "start"), (chosen.end, "end")):
            if day:
                month = F.trunc(F.lit(day).cast("date"), "month")
                df = df.where(F.col("month_start") >= month if name == "start" else F.col("month_start") <= month)
    if chosen.start:
        df = df.where(F.col("date") >= F.lit(chosen.start).cast("date"))
    if chosen.end:
        df = df.where(F.col("date") <= F.lit(chosen.end).cast("date"))
    lists = {
        "category": chosen.categories,
        "store_id": chosen.stores,
        "region": chosen.regions,
        "product_id": chosen.products,
    }
    for column, values in lists.items():
        if values:
            df = df.where(F.col(column).isin(*values))
    return df


def top_keys(df: DataFrame, key: str, n: int, value: str = "units_sold") -> DataFrame:
    """The n keys with the largest sums."""
    sums = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias(value))
    return largest(sums, value, n, key)


def topn_semi(df: DataFrame, key: str = "product_id", n: int = 10) -> DataFrame:
    """Rows of the top n keys. The broadcast side holds n rows by construction."""
    return df.join(F.broadcast(top_keys(df, key, n).select(key)), key, "left_semi")


def latest_day(df: DataFrame) -> DataFrame:
    """Rows of the last day; the day is a scalar subquery that reaches the scan.

    Of a table that keeps its `month_start`, both the day and its rows are looked for in the last month's folder.
    """
    if "month_start" in df.columns:
        df = df.where(F.col("month_start") == df.agg(F.max("month_start")).scalar())
    return df.where(F.col("date") == df.agg(F.max("date")).scalar())


def poor_forecast_rows(df: DataFrame, p: float = 0.1) -> DataFrame:
    """Rows whose forecast accuracy is below its p quantile, which is a number in the plan."""
    scored = df.withColumn("forecast_accuracy", forecast_accuracy())
    limit = quantile(scored, "forecast_accuracy", p)
    return scored.where(F.col("forecast_accuracy") < F.lit(limit).cast("double"))


def poor_forecast_head(df: DataFrame, limit: float = 0.5, n: int = 10) -> DataFrame:
    """The first n rows with an accuracy below a fixed limit."""
    scored = df.withColumn("forecast_accuracy", forecast_accuracy())
    return scored.where(F.col("forecast_accuracy") < limit).orderBy(*df.columns).limit(n)


def status_head(df: DataFrame, status: str, n: int = 10, params: Params = DEFAULTS) -> DataFrame:
    """P5: the first n rows of a supply status, in the order of the table's columns."""
    marked = df.withColumn("supply_status", supply_status(params))
    return marked.where(F.col("supply_status") == status).orderBy(*df.columns).limit(n)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """P6."""
    return df.na.drop()


def positive_points(df: DataFrame, price: str = "price", quantity: str = "units_sold") -> DataFrame:
    """P7."""
    return df.where((F.col(price) > 0) & (F.col(quantity) > 0))


def filter_options(df: DataFrame) -> DataFrame:
    """The values each filter offers, and the first and last day."""
    fields = ["category", "store_id", "region", "product_id"]
    values = df.select(*fields).unpivot([], fields, "field", "value").where(F.col("value").isNotNull()).distinct()
    days = df.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))
    ends = days.select(*[F.col(c).cast("string").alias(c) for c in days.columns])
    return values.unionByName(ends.unpivot([], list(ends.columns), "field", "value"))
