"""Seasonality of sales.

Every operator but W17 also accepts the sums of `calendar_sums` or `product_sums` in place
of the fact, so that a batch of them reads the fact once.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.nulls import known
from larder.functions.ranking import best_per_group, largest, smallest
from larder.functions.sums import count, mean, summed
from larder.operators.filters import top_keys, topn_semi
from larder.schema import MONTH_NAMES

UNITS = "units_sold"


def mean_by(df: DataFrame, *keys: str) -> DataFrame:
    """Mean units by one or more columns."""
    return known(df, *keys).groupBy(*keys).agg(mean(df, UNITS).alias("avg_units"))


def _month_name() -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.col("month_no")).alias("month_name")


def monthly_by(df: DataFrame, key: str) -> DataFrame:
    """Mean units by month and key; months without sales stay as NULL.

    The pivot over the twelve fixed months aggregates by (key, month) first, so the wide
    form holds one row per key.
    """
    dated = known(df, "date", key).withColumn("month_no", F.month("date"))
    wide = dated.groupBy(key).pivot("month_no", list(range(1, 13))).agg(mean(df, UNITS))
    months = F.array(*[F.struct(F.lit(m).alias("month_no"), F.col(f"`{m}`").alias("avg_units")) for m in range(1, 13)])
    return wide.select(key, F.inline(months)).select("month_no", _month_name(), key, "avg_units")


def peak_month(df: DataFrame, key: str) -> DataFrame:
    """The month with the largest mean per key."""
    best = best_per_group(monthly_by(df, key), key, "avg_units", "month_no")
    return best.select(key, F.col("month_name").alias("peak_month"), F.col("avg_units").alias("peak_value"))


def seasonality_index(df: DataFrame, key: str = "category") -> DataFrame:
    """(max - min) / mean of the monthly means, where that mean is positive."""
    months = monthly_by(df, key).groupBy(key).agg(
        F.max("avg_units").alias("high"), F.min("avg_units").alias("low"), F.avg("avg_units").alias("mid")
    )
    return months.where(F.col("mid") > 0).select(key, ((F.col("high") - F.col("low")) / F.col("mid")).alias("seasonality_index"))


def top_products(df: DataFrame, n: int = 10) -> DataFrame:
    """W4."""
    return top_keys(df, "product_id", n)


def monthly_by_top_product(df: DataFrame, n: int = 10) -> DataFrame:
    """W5."""
    return monthly_by(topn_semi(df, "product_id", n), "product_id")


def product_peak_month(df: DataFrame, n: int = 10) -> DataFrame:
    """W6."""
    return peak_month(topn_semi(df, "product_id", n), "product_id")


def monthly_overall(df: DataFrame) -> DataFrame:
    """W9."""
    return monthly_by(df.withColumn("all_rows", F.lit("all")), "all_rows").drop("all_rows")


def yearly_monthly(df: DataFrame) -> DataFrame:
    """Mean units by year and month."""
    return monthly_by(known(df, "date").withColumn("year", F.year("date")), "year")


def seasonality_summary(df: DataFrame) -> DataFrame:
    """Peak month, most seasonal category, best and worst weather.

    All four come from one small table of sums, so the fact is read and shuffled once.
    """
    cube = (
        df.withColumn("month_no", F.month("date")).groupBy("category", "weather", "month_no")
        .agg(F.sum(UNITS).alias("units"), count(df, UNITS).alias("n"))
    )

    def means(*keys: str) -> DataFrame:
        # A NULL key gets a NULL value instead of a filter, which would be moved below the shared table.
        sums = cube.groupBy(*keys).agg(F.sum("units").alias("units"), F.sum("n").alias("n"))
        ratio = F.col("units") / F.nullif(F.col("n"), F.lit(0))
        return sums.select(*keys, F.when(reduce(and_, (F.col(k).isNotNull() for k in keys)), ratio).alias("value"))

    month = largest(means("month_no"), "value", 1, "month_no").select(F.lit("peak_month").alias("item"), _month_name().alias("label"), "value")
    spread = means("category", "month_no").groupBy("category").agg(
        F.max("value").alias("high"), F.min("value").alias("low"), F.avg("value").alias("mid")
    ).where(F.col("mid") > 0).select("category", ((F.col("high") - F.col("low")) / F.col("mid")).alias("value"))
    category = largest(spread, "value", 1, "category").select(
        F.lit("most_seasonal_category").alias("item"), F.col("category").alias("label"), "value"
    )
    weather = means("weather")
    best = largest(weather, "value", 1, "weather").select(F.lit("best_weather").alias("item"), F.col("weather").alias("label"), "value")
    worst = smallest(weather, "value", 1, "weather").select(F.lit("worst_weather").alias("item"), F.col("weather").alias("label"), "value")
    return month.unionByName(category).unionByName(best).unionByName(worst)


def top_by_season(df: DataFrame, key: str) -> DataFrame:
    """The key with the largest unit sum in each season."""
    sums = known(df, "seasonality", key).groupBy("seasonality", key).agg(F.sum(UNITS).alias(UNITS))
    return best_per_group(sums, "seasonality", UNITS, key)


def seasonal_by_top_product(df: DataFrame, n: int = 5) -> DataFrame:
    """W16."""
    return mean_by(topn_semi(df, "product_id", n), "seasonality", "product_id")


def high_variance_products(df: DataFrame, n: int = 5) -> DataFrame:
    """The largest coefficients of variation."""
    spread = known(df, "product_id").groupBy("product_id").agg(F.avg(UNITS).alias("mean"), F.stddev_samp(UNITS).alias("std"))
    return largest(spread.withColumn("cv", F.col("std") / F.nullif(F.col("mean"), F.lit(0.0))), "cv", n, "product_id")


def day_of_week_sales(df: DataFrame) -> DataFrame:
    """W20."""
    if "day_name" not in df.columns:
        df = df.withColumn("day_name", F.date_format("date", "EEEE"))
    return mean_by(df, "day_name")


def calendar_sums(df: DataFrame) -> DataFrame:
    """Sums by month, weekday and the small dimensions; the date of a row is the first of its month."""
    dated = df.withColumns({"day_name": F.date_format("date", "EEEE"), "date": F.trunc("date", "month")})
    keys = ["date", "day_name", "category", "region", "weather", "holiday_promotion", "seasonality"]
    return summed(dated, keys, units_sold=F.col(UNITS))


def product_sums(df: DataFrame) -> DataFrame:
    """Sums by product, month and season."""
    months = df.withColumn("date", F.trunc("date", "month"))
    return summed(months, ["product_id", "date", "seasonality"], units_sold=F.col(UNITS))
