"""Row-level expressions (C1-C16). All are built-in column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.params import DEFAULTS, Params


def _guarded(x: Column, y: Column) -> Column:
    """x / y, NULL where y is zero."""
    return x / F.nullif(y, F.lit(0))


def calendar_columns(df: DataFrame, date: str = "date") -> DataFrame:
    """Calendar parts of the day; the week starts on Monday = 0, weeks are ISO weeks."""
    day = F.col(date)
    return df.withColumns({
        "year": F.year(day),
        "quarter": F.quarter(day),
        "month": F.month(day),
        "week": F.weekofyear(day),
        "day": F.dayofmonth(day),
        "weekday": F.weekday(day),
        "month_name": F.date_format(day, "MMM"),
        "month_year": F.date_format(day, "yyyy-MM"),
    })


def inventory_sales_ratio() -> Column:
    """C2."""
    return _guarded(F.col("inventory_level"), F.col("units_sold"))


def sell_through_rate() -> Column:
    """C3."""
    return _guarded(F.col("units_sold"), F.col("inventory_level") + F.col("units_sold"))


def forecast_accuracy() -> Column:
    """C4: relative to the signed forecast, so a negative forecast gives more than 1."""
    forecast = F.col("demand_forecast")
    return 1 - _guarded(F.abs(forecast - F.col("units_sold")), forecast)


def supply_gap() -> Column:
    """C5."""
    return F.col("inventory_level") - F.col("units_sold")


def optimal_inventory(params: Params = DEFAULTS) -> Column:
    """C6."""
    return F.col("units_sold") * F.lit(float(params.optimal_inventory_factor))


def supply_status(params: Params = DEFAULTS) -> Column:
    """C7."""
    have, sold = F.col("inventory_level"), F.col("units_sold")
    return (
        F.when(have < sold, "Undersupplied")
        .when((have >= sold) & (have <= optimal_inventory(params)), "Optimal")
        .when(have > optimal_inventory(params), "Oversupplied")
        .otherwise("Unknown")
    )


def net_revenue() -> Column:
    """C8."""
    return F.col("price") * F.col("units_sold") * (1 - F.col("discount") / 100)


def price_difference() -> Column:
    """Own price minus the competitor's."""
    return F.col("price") - F.col("competitor_pricing")


def price_difference_pct() -> Column:
    """The same in percent of the competitor's price."""
    return _guarded(price_difference(), F.col("competitor_pricing")) * 100


def price_bucket_labels(bins: Sequence[int]) -> list[str]:
    """Labels of the price buckets; the two outer ones name one edge only."""
    inner = [f"{low}% to {high}%" for low, high in zip(bins[1:-2], bins[2:-1])]
    return [f"<{bins[1]}%", *inner, f">{bins[-2]}%"]


def price_bucket_no(pct: Column, params: Params = DEFAULTS) -> Column:
    """0-based bucket, closed on the right; NULL outside of the bins."""
    bins = params.price_diff_bins
    bucket = F.lit(None).cast("int")
    for number in reversed(range(len(bins) - 1)):
        bucket = F.when((pct > bins[number]) & (pct <= bins[number + 1]), number).otherwise(bucket)
    return bucket


def price_bucket_label(number: Column, params: Params = DEFAULTS) -> Column:
    """The label of a bucket number."""
    labels = F.array(*[F.lit(label) for label in price_bucket_labels(params.price_diff_bins)])
    return F.get(labels, number)


def clip(x: Column, low: float, high: float) -> Column:
    """C11: NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def one_hot(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """One 0/1 column for each of the given values."""
    return df.withColumns({
        f"{column}_{value}": F.when(F.col(column) == value, 1).otherwise(0) for value in values
    })


def log_transform(price: Column, quantity: Column) -> tuple[Column, Column]:
    """Natural logarithms; NULL for values that are not positive."""
    return tuple(F.log(F.when(x > 0, x)) for x in (price, quantity))


def recode_flag(flag: Column) -> Column:
    """C14."""
    return F.when(flag == 1, "Yes").otherwise("No")


# The advice texts, from the least to the most elastic tier.
CATEGORY_ADVICE = (
    "Consider price increase, demand is highly inelastic",
    "Modest price increase possible, demand is inelastic",
    "Maintain current pricing, moderate elasticity",
    "Consider price decrease, demand is highly elastic",
)
PRODUCT_ADVICE = (
    "Increase price by 5-10%, current ${}",
    "Small increase (2-5%), current ${}",
    "Maintain near ${}, monitor competition",
    "Decrease price or offer promotions, current ${}",
)
ADVICE_LIMITS = (-0.5, -1.0, -1.5)


def _by_tier(elasticity: Column, texts: Sequence[Column]) -> Column:
    tier = F.when(elasticity > ADVICE_LIMITS[0], texts[0])
    for limit, text in zip(ADVICE_LIMITS[1:], texts[1:]):
        tier = tier.when(elasticity > limit, text)
    return tier.otherwise(texts[-1])


def category_price_action(elasticity: Column) -> Column:
    """C15."""
    return _by_tier(elasticity, [F.lit(text) for text in CATEGORY_ADVICE])


def product_price_action(elasticity: Column, avg_price: Column) -> Column:
    """The text carries the average price with two decimals."""
    shown = F.format_string("%.2f", avg_price)
    texts = []
    for text in PRODUCT_ADVICE:
        before, after = text.split("{}")
        texts.append(F.concat(F.lit(before), shown, F.lit(after)))
    return _by_tier(elasticity, texts)
