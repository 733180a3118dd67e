"""Data understanding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.columns import clip, forecast_accuracy, inventory_sales_ratio
from larder.functions.nulls import known
from larder.functions.quantiles import column_quantiles, exact_quantiles
from larder.functions.ranking import largest, top_per_group
from larder.functions.spread import per_column
from larder.schema import CATEGORICAL_COLUMNS, NUMERIC_COLUMNS
from larder.session import durable

GROUPED_DIMENSIONS = ("category", "region", "seasonality", "weather", "holiday_promotion")


def basic_info(df: DataFrame) -> DataFrame:
    """A1: per column its type and missing values, with the size of the table."""
    counts = per_column(
        df, df.columns, n_rows=lambda c: F.count(F.lit(1)), n_missing=lambda c: F.count_if(F.col(c).isNull())
    )
    types = F.create_map(*[F.lit(x) for field in df.schema for x in (field.name, field.dataType.simpleString())])
    return counts.select(
        "column_name", F.element_at(types, F.col("column_name")).alias("data_type"), "n_rows",
        F.lit(len(df.columns)).cast("long").alias("n_columns"), "n_missing",
    )


def null_counts(df: DataFrame) -> DataFrame:
    """A2."""
    return per_column(df, df.columns, n_missing=lambda c: F.count_if(F.col(c).isNull()))


def row_digest(df: DataFrame) -> list[Column]:
    """Two 64-bit digests of a row, which together tell rows apart; NULLs have a mark of their own."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns])
    columns = [F.col(c) for c in df.columns]
    return [F.xxhash64(nulls, *columns).alias("digest_a"), F.xxhash64(*reversed(columns), nulls, F.lit(1)).alias("digest_b")]


def duplicate_count(df: DataFrame) -> DataFrame:
    """A3: repeats after the first, NULLs being equal.

    Rows are compared by a digest of 128 bits, so 16 bytes a row are shuffled however wide or long
    the columns are; copies merge before the shuffle.
    """
    copies = df.select(*row_digest(df)).groupBy("digest_a", "digest_b").agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def temporal_range(df: DataFrame) -> DataFrame:
    """A4."""
    span = F.datediff(F.max("date"), F.min("date")) + 1
    return df.agg(
        F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        span.cast("long").alias("span_days"), F.count_distinct("date").alias("n_dates"),
    )


def monthly_counts(df: DataFrame) -> DataFrame:
    """A5."""
    dated = df.where(F.col("date").isNotNull())
    return dated.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(F.count("*").alias("n"))


def category_counts(df: DataFrame, columns: Sequence[str] = CATEGORICAL_COLUMNS, top: int = 10) -> DataFrame:
    """Value counts per column, the most frequent ones, with the number of values."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counts = (
        texts.unpivot([], list(columns), "column_name", "value")
        .where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    )
    sizes = counts.groupBy("column_name").agg(F.count("*").alias("n_values"))
    best = top_per_group(counts, ["column_name"], [F.desc("n"), F.col("value")], top)
    return best.join(F.broadcast(sizes), "column_name")  # one row per named column


def numeric_describe(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Min, max, mean, median, sample deviation and range."""
    quantiles = column_quantiles(df, columns, [0.5]).select("column_name", F.get("quantiles", F.lit(0)).alias("median"))
    moments = _moments(df, columns).withColumn("range", F.col("max") - F.col("min")).drop("n")
    return moments.join(F.broadcast(quantiles), "column_name")


def summary_stats(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Count, mean, deviation, min, quartiles, max."""
    quartiles = column_quantiles(df, columns, [0.25, 0.5, 0.75]).select(
        "column_name", *[F.get("quantiles", F.lit(i)).alias(name) for i, name in enumerate(("q25", "q50", "q75"))]
    )
    return _moments(df, columns).join(F.broadcast(quartiles), "column_name")


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return per_column(
        df, columns,
        n=lambda c: F.count(c),
        mean=lambda c: F.avg(c),
        std=lambda c: F.stddev_samp(c),
        min=lambda c: F.min(c).cast("double"),
        max=lambda c: F.max(c).cast("double"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS, digits: int = 2) -> DataFrame:
    """Pearson correlation of all pairs, both ways, from one aggregate."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs],
                  *[F.corr(F.col(a).cast("double"), F.col(a).cast("double")).alias(f"{a}|{a}") for a in columns])
    cells = [(a, b, f"{a}|{b}") for a, b in pairs] + [(b, a, f"{a}|{b}") for a, b in pairs]
    cells += [(a, a, f"{a}|{a}") for a in columns]
    rows = F.array(*[
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.bround(F.col(f"`{name}`"), digits).alias("r"))
        for a, b, name in cells
    ])
    return wide.select(F.inline(rows))


def pair_correlation(df: DataFrame, a: str = "price", b: str = "units_sold", digits: int = 3) -> DataFrame:
    """A10."""
    return df.agg(F.bround(F.corr(F.col(a), F.col(b).cast("double")), digits).alias("r"))


def group_means(df: DataFrame, dimensions: Sequence[str] = GROUPED_DIMENSIONS,
                columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Column means by each dimension, from one pass over grouping sets."""
    named = df.select(*[F.col(d).cast("string").alias(d) for d in dimensions], *columns)
    sets = named.groupingSets([[d] for d in dimensions], *dimensions).agg(
        *[F.avg(c).alias(c) for c in columns], *[F.grouping(d).alias(f"_{d}") for d in dimensions]
    )
    which = F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.lit(d)) for d in dimensions])
    long = sets.select(which.alias("dimension"), F.coalesce(*dimensions).alias("value"), *columns)
    long = long.where(F.col("value").isNotNull())
    return long.unpivot(["dimension", "value"], list(columns), "column_name", "mean").withColumn(
        "mean", F.bround("mean", 2)
    )


def top_sums(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n keys with the largest unit sums."""
    sums = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("units_sold").alias("units_sold"))
    return largest(sums, "units_sold", n, key)


def category_totals(df: DataFrame) -> DataFrame:
    """A13."""
    known = df.where(F.col("category").isNotNull())
    return known.groupBy("category").agg(F.sum("units_sold").alias("units_sold")).orderBy(F.desc("units_sold"), "category")


def mean_by_dimension(df: DataFrame, dimension: str, digits: int = 2) -> DataFrame:
    """A14."""
    known = df.where(F.col(dimension).isNotNull())
    return known.groupBy(dimension).agg(F.bround(F.avg("units_sold"), digits).alias("avg_units"))


def mean_inventory_ratio(df: DataFrame) -> DataFrame:
    """Rows without sales are left out instead of making the mean infinite."""
    return df.agg(F.avg(inventory_sales_ratio()).alias("avg_inventory_sales_ratio"))


def mean_forecast_accuracy(df: DataFrame) -> DataFrame:
    """A16."""
    return df.agg(F.avg(forecast_accuracy()).alias("avg_forecast_accuracy"))


MOST_BINS = 10_000


def histogram(df: DataFrame, value: str | Column, bins: int | None = None) -> DataFrame:
    """Equal bins over the range, the last one closed, empty bins kept.

    Without a number of bins the width is the smaller of the Sturges and the Freedman-Diaconis width, and
    at least 1 for whole numbers; if that makes more than MOST_BINS, neighbours are joined evenly, so no
    row is left out. Range and width are found first and stand as numbers in the plan, which is one
    scan with partial counts.
    """
    column = F.col(value) if isinstance(value, str) else value
    rows = df.select(column.alias("x")).where(F.col("x").isNotNull())
    whole = isinstance(rows.schema["x"].dataType, T.IntegralType)
    ends = rows.agg(F.count("*").alias("n"), F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high")).first()
    if not ends.n:
        return df.sparkSession.createDataFrame([], "bin_no long, bin_low double, bin_high double, n long")
    low, high, n = F.lit(ends.low), F.lit(ends.high), F.lit(float(ends.n))
    if bins:
        count = F.lit(bins)
    else:
        quartiles = exact_quantiles(rows, "x", [0.25, 0.75]).first().quantiles
        sturges = (high - low) / (F.log2(n) + 1)
        diaconis = 2 * (F.lit(quartiles[1]) - F.lit(quartiles[0])) / F.pow(n, F.lit(1 / 3))
        width = F.when(diaconis > 0, F.least(sturges, diaconis)).otherwise(sturges)
        width = F.greatest(width, F.lit(1.0)) if whole else width
        count = F.greatest(F.when(width > 0, F.ceil((high - low) / F.nullif(width, F.lit(0.0)))).otherwise(1), F.lit(1))
    widen = F.when(low == high, 0.5).otherwise(0.0)  # a single value gets a range of one
    joined = F.ceil(count / F.ceil(count / MOST_BINS))
    shape = df.sparkSession.range(1).select((low - widen).alias("low"), (high + widen).alias("high"), joined.cast("long").alias("bins"))
    one = shape.first()
    low, high, number = F.lit(one.low), F.lit(one.high), F.lit(one.bins)
    bin_no = F.least(F.floor((F.col("x") - low) / (high - low) * number), number - 1).cast("long")
    counts = rows.groupBy(bin_no.alias("bin_no")).agg(F.count("*").alias("n"))
    width = (high - low) / number
    return df.sparkSession.range(one.bins).select(F.col("id").alias("bin_no")).join(counts, "bin_no", "left").select(
        "bin_no", (low + F.col("bin_no") * width).alias("bin_low"),
        (low + (F.col("bin_no") + 1) * width).alias("bin_high"), F.coalesce("n", F.lit(0)).alias("n"))


def ratio_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """The inventory ratio clipped to [0, 10]."""
    return histogram(df, clip(inventory_sales_ratio(), 0.0, 10.0), bins)


def box_stats(df: DataFrame, group: str = "category", value: str = "units_sold") -> DataFrame:
    """Quartiles and whiskers, the outermost values within 1.5 IQR of the box.

    The quartiles of all groups come from shared splitters, the whiskers from conditional extremes, so only
    partial aggregates meet, however large a group is.
    """
    rows = known(df.select(group, F.col(value).cast("double").alias("x")), group, "x")
    q1, median, q3 = (F.get("quantiles", F.lit(i)) for i in range(3))
    boxes = exact_quantiles(rows, "x", [0.25, 0.5, 0.75], [group]).select(
        group, q1.alias("q1"), median.alias("median"), q3.alias("q3"), (q1 - 1.5 * (q3 - q1)).alias("f1"), (q3 + 1.5 * (q3 - q1)).alias("f2"))
    inside = F.when(F.col("x").between(F.col("f1"), F.col("f2")), F.col("x"))
    return rows.join(boxes, group).groupBy(group, "q1", "median", "q3").agg(
        F.min(inside).alias("low_whisker"), F.max(inside).alias("high_whisker"))


def monthly_totals(df: DataFrame) -> DataFrame:
    """Units per calendar month, empty months as zero."""
    dated = df.where(F.col("date").isNotNull())
    sums = dated.groupBy(F.trunc("date", "month").alias("month_start")).agg(F.sum("units_sold").alias("units_sold"))
    spine = sums.agg(F.min("month_start").alias("a"), F.max("month_start").alias("b")).select(
        F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month_start")
    )
    return spine.join(sums, "month_start", "left").na.fill(0, ["units_sold"])


def column_profile(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Per column counts, distinct values, zeros, extremes and quartiles.

    approx_distinct replaces the exact distinct counts, which shuffle every distinct
    value of every column, by sketches. The fact is written once: the measures and the quartiles
    read it without joining it again, and each distinct count reads its own column only, where one
    aggregate over all columns would take every row once per column.
    """
    df = durable(df, "profiled_fact")
    kinds = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema}
    numbers = [c for c, number in kinds.items() if number]

    def number(c: str, x: Column) -> Column:
        return x.cast("double") if kinds[c] else F.lit(None).cast("double")

    def text(c: str, x: Column) -> Column:
        return F.lit(None).cast("string") if kinds[c] else x.cast("string")

    measures = dict(
        n_rows=lambda c: F.count(F.lit(1)),
        n_missing=lambda c: F.count_if(F.col(c).isNull()),
        n_zeros=lambda c: F.count_if(F.col(c) == 0) if kinds[c] else F.count_if(F.lit(False)),
        min_value=lambda c: number(c, F.min(c)),
        max_value=lambda c: number(c, F.max(c)),
        mean=lambda c: F.avg(c) if kinds[c] else F.max(F.lit(None).cast("double")),
        first_text=lambda c: text(c, F.min(c)),
        last_text=lambda c: text(c, F.max(c)),
    )
    if approx_distinct:
        profile = per_column(df, df.columns, **measures, n_distinct=lambda c: F.approx_count_distinct(c))
    else:
        distinct = reduce(DataFrame.unionByName, [
            known(df.select(c), c).distinct().agg(F.lit(c).alias("column_name"), F.count("*").alias("n_distinct")) for c in df.columns])
        profile = per_column(df, df.columns, **measures).join(F.broadcast(distinct), "column_name")
    quartiles = column_quantiles(df, numbers, [0.25, 0.5, 0.75]).select(
        "column_name", *[F.get("quantiles", F.lit(i)).alias(name) for i, name in enumerate(("q25", "q50", "q75"))]
    )
    return profile.join(F.broadcast(quartiles), "column_name", "left")
