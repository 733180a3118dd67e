"""Schema of the daily sales fact table."""

from __future__ import annotations

from pyspark.sql import types as T

# Header names of the input file and our names and types for them.
FACT_FIELDS = (
    ("Date", "date", T.DateType()),
    ("Store ID", "store_id", T.StringType()),
    ("Product ID", "product_id", T.StringType()),
    ("Category", "category", T.StringType()),
    ("Region", "region", T.StringType()),
    ("Inventory Level", "inventory_level", T.LongType()),
    ("Units Sold", "units_sold", T.LongType()),
    ("Units Ordered", "units_ordered", T.LongType()),
    ("Demand Forecast", "demand_forecast", T.DoubleType()),
    ("Price", "price", T.DoubleType()),
    ("Discount", "discount", T.IntegerType()),
    ("Weather Condition", "weather", T.StringType()),
    ("Holiday/Promotion", "holiday_promotion", T.IntegerType()),
    ("Competitor Pricing", "competitor_pricing", T.DoubleType()),
    ("Seasonality", "seasonality", T.StringType()),
)

FACT_SCHEMA = T.StructType([T.StructField(name, kind) for _, name, kind in FACT_FIELDS])
FACT_COLUMNS = tuple(FACT_SCHEMA.names)

NUMERIC_COLUMNS = (
    "inventory_level", "units_sold", "units_ordered", "demand_forecast",
    "price", "discount", "competitor_pricing",
)
CATEGORICAL_COLUMNS = (
    "store_id", "product_id", "category", "region", "weather", "holiday_promotion", "seasonality",
)
STATUSES = ("Optimal", "Oversupplied", "Undersupplied", "Unknown")
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
