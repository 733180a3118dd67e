"""Data-quality checks (Q1-Q9)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.quantiles import column_quantiles
from larder.functions.spread import per_column
from larder.operators.profile import duplicate_count
from larder.schema import FACT_COLUMNS, FACT_SCHEMA
from larder.session import durable

NON_NEGATIVE = ("price", "units_sold", "inventory_level", "demand_forecast")
OUTLIER_COLUMNS = (
    "inventory_level", "units_sold", "units_ordered", "demand_forecast", "price", "discount",
    "holiday_promotion", "competitor_pricing",
)


@dataclass(frozen=True)
class Rule:
    """A rule holds for a row when its condition is true; NULL counts as failed."""

    column: str
    message: str
    holds: str


# The messages. The conditions work on text and on typed columns alike.
RULES = (
    Rule("date", "Invalid date", "try_cast(date AS date) IS NOT NULL"),
    Rule("store_id", "Invalid Store ID", "length(trim(store_id)) > 0"),
    Rule("product_id", "Invalid Product ID", "length(trim(product_id)) > 0"),
    Rule("category", "Category must be string", "length(category) > 0"),
    Rule("region", "Region must be string", "length(region) > 0"),
    Rule("price", "Price must be positive", "try_cast(price AS double) >= 0"),
    Rule("units_sold", "Units Sold must be positive", "try_cast(units_sold AS double) >= 0"),
    Rule("inventory_level", "Inventory Level must be positive", "try_cast(inventory_level AS double) >= 0"),
    Rule("demand_forecast", "Demand Forecast must be positive", "try_cast(demand_forecast AS double) >= 0"),
    Rule("discount", "Discount must be between 0-100%", "try_cast(discount AS double) BETWEEN 0 AND 100"),
    Rule("weather", "Weather must be string", "length(weather) > 0"),
    Rule("holiday_promotion", "Holiday/Promotion must be 0 or 1", "try_cast(holiday_promotion AS double) IN (0, 1)"),
    Rule("competitor_pricing", "Competitor Pricing must be positive", "try_cast(competitor_pricing AS double) >= 0"),
)


def _fails(rule: Rule) -> Column:
    return ~F.coalesce(F.expr(rule.holds), F.lit(False))


def _percent(part: Column, whole: Column) -> Column:
    return part * 100.0 / F.nullif(whole, F.lit(0))


def missing_report(df: DataFrame) -> DataFrame:
    """Q1."""
    counts = per_column(
        df, df.columns, n_missing=lambda c: F.count_if(F.col(c).isNull()), n_rows=lambda c: F.count(F.lit(1))
    )
    return counts.select("column_name", "n_missing", _percent(F.col("n_missing"), F.col("n_rows")).alias("pct"))


def negative_report(df: DataFrame, columns: Sequence[str] = NON_NEGATIVE) -> DataFrame:
    """Q2."""
    counts = per_column(
        df, columns, n_negative=lambda c: F.count_if(F.col(c) < 0), n_rows=lambda c: F.count(F.lit(1))
    )
    return counts.select("column_name", "n_negative", _percent(F.col("n_negative"), F.col("n_rows")).alias("pct"))


def rule_violations(df: DataFrame, row_id: Sequence[str] = ("date", "store_id", "product_id"),
                    rules: Sequence[Rule] = RULES) -> DataFrame:
    """Q3: one row per failed rule and fact row, found without a shuffle."""
    failed = F.array(*[
        F.when(_fails(rule), F.struct(F.lit(rule.column).alias("column_name"), F.lit(rule.message).alias("message")))
        for rule in rules
    ])
    return df.select(*row_id, F.inline(F.array_compact(failed)))


def rule_summary(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Q4: violations and a passed flag per rule, zeros included."""
    wide = df.agg(*[F.count_if(_fails(rule)).alias(rule.column) for rule in rules])
    rows = F.array(*[
        F.struct(F.lit(rule.column).alias("column_name"), F.lit(rule.message).alias("message"),
                 F.col(rule.column).alias("n_violations"), (F.col(rule.column) == 0).alias("passed"))
        for rule in rules
    ])
    return wide.select(F.inline(rows))


def schema_check(df: DataFrame, expected: T.StructType = FACT_SCHEMA) -> DataFrame:
    """Q5: expected against actual columns and types."""
    want = {f.name: f.dataType.simpleString() for f in expected}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = [
        (name, want.get(name), have.get(name), want.get(name) == have.get(name))
        for name in [*want, *[name for name in have if name not in want]]
    ]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, expected_type string, actual_type string, passed boolean"
    )


def _fences(df: DataFrame, columns: Sequence[str], factor: float) -> dict[str, tuple[Column, Column]]:
    """Lower and upper fence of each column, as numbers; NULL for a column without values."""
    found = {r.column_name: r.quantiles for r in column_quantiles(df, columns, [0.25, 0.75]).collect()}  # a row per named column
    out = {}
    for c in columns:
        q1, q3 = found.get(c, (None, None))
        ends = (None, None) if q1 is None else (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
        out[c] = tuple(F.lit(e).cast("double") for e in ends)
    return out


def _outside(c: str, fences: dict[str, tuple[Column, Column]]) -> Column:
    return F.count_if((F.col(c) < fences[c][0]) | (F.col(c) > fences[c][1]))


def iqr_outliers(df: DataFrame, columns: Sequence[str] = OUTLIER_COLUMNS, factor: float = 1.5) -> DataFrame:
    """Q6: values outside of the quartiles by more than 1.5 IQR, per column.

    The columns are written once, so that the passes of the quartiles do not join the fact again. The fences stand as
    numbers in the plan, so the counts are one wide aggregate over the fact.
    """
    rows = durable(df.select(*columns), "outlier_columns")
    fences = _fences(rows, columns, factor)
    counts = per_column(
        rows, columns,
        low_fence=lambda c: F.first(fences[c][0]),
        high_fence=lambda c: F.first(fences[c][1]),
        n_outliers=lambda c: _outside(c, fences),
        n_rows=lambda c: F.count(F.lit(1)),
    )
    return counts.select(
        "column_name", "low_fence", "high_fence", "n_outliers", _percent(F.col("n_outliers"), F.col("n_rows")).alias("pct")
    )


def date_continuity(df: DataFrame) -> DataFrame:
    """Q7: days spanned against distinct days."""
    days = df.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.count_distinct("date").alias("n_dates"))
    span = (F.datediff("max_date", "min_date") + 1).cast("long")
    return days.select("min_date", "max_date", span.alias("span_days"), "n_dates",
                       (span - F.col("n_dates")).alias("n_missing"), (span == F.col("n_dates")).alias("passed"))


def missing_days(df: DataFrame) -> DataFrame:
    """Q7: the days without any row."""
    days = df.where(F.col("date").isNotNull()).select("date").distinct()
    spine = days.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.expr("explode(sequence(a, b)) AS date"))
    return spine.join(days, "date", "left_anti")


def validation_status(df: DataFrame) -> DataFrame:
    """Q8: one row with the outcome of every check and of all together.

    All counts over rows are one wide aggregate, the fences being numbers; duplicates are counted by digests. The fact
    is written once, so that no pass joins it again.
    """
    df = durable(df, "checked_fact")
    present = [c for c in FACT_COLUMNS if c in df.columns]
    missing = sum((F.col(c).isNull().cast("long") for c in present), F.lit(0))
    negative = sum((F.coalesce((F.col(c) < 0).cast("long"), F.lit(0)) for c in NON_NEGATIVE), F.lit(0))
    broken = sum((_fails(rule).cast("long") for rule in RULES), F.lit(0))
    span = F.datediff(F.max("date"), F.min("date")) + 1
    fences = _fences(df, OUTLIER_COLUMNS, 1.5)
    counts = df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(broken), F.lit(0)).alias("n_violations"),
        sum((_outside(c, fences) for c in OUTLIER_COLUMNS), F.lit(0).cast("long")).alias("n_outliers"),
        F.coalesce(span.cast("long") - F.count_distinct("date"), F.lit(0)).alias("n_missing_days"),
        F.coalesce(F.sum(negative), F.lit(0)).alias("n_negative"),
    )
    parts = ["n_missing", "n_duplicates", "n_violations", "n_outliers", "n_missing_days", "n_negative"]
    whole = counts.withColumn("n_duplicates", duplicate_count(df).scalar()).select("n_rows", "n_columns", *parts)
    return whole.withColumn("passed", F.greatest(*parts) == 0)


def light_status(df: DataFrame) -> DataFrame:
    """Q9: passed when no value is missing and no inventory is negative."""
    missing = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0))
    return df.agg(
        F.coalesce(F.sum(missing), F.lit(0)).alias("n_missing"),
        F.count_if(F.col("inventory_level") < 0).alias("n_negative_inventory"),
    ).withColumn("passed", (F.col("n_missing") == 0) & (F.col("n_negative_inventory") == 0))
