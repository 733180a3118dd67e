"""Series, splits, features and scores for demand forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.nulls import known
from larder.functions.ranking import smallest
from larder.operators.filters import top_keys
from larder.params import DEFAULTS, Params
from larder.session import durable

SERIES = ("kind", "series_id")
LAGS = (1, 7, 14, 28)
WINDOWS = (7, 14, 28)


def daily_totals(df: DataFrame) -> DataFrame:
    """F1."""
    return known(df, "date").groupBy("date").agg(F.sum("units_sold").alias("units_sold"))


def _numbered_days(daily: DataFrame) -> DataFrame:
    """The days that occur, numbered from 1: one row per calendar day."""
    order = Window.orderBy("date")  # one row per calendar day
    return daily.select("date").distinct().withColumn("day_no", F.row_number().over(order))


def with_gaps(daily: DataFrame, key: str, numbered: DataFrame) -> DataFrame:
    """Run lengths in place of days without sales: one row per key and day with sales.

    n_days counts the days that occur from this one up to the key's next one, n_before those before the
    key's first one (0 on its other rows). They add up to the number of days for each key.
    """
    by_day = Window.partitionBy(key).orderBy("day_no")  # one row per calendar day
    last = numbered.agg(F.max("day_no")).scalar()
    placed = daily.join(numbered, "date")
    return placed.withColumns({
        "n_days": F.coalesce(F.lead("day_no").over(by_day), last + 1) - F.col("day_no"),
        "n_before": F.when(F.lag("day_no").over(by_day).isNull(), F.col("day_no") - 1).otherwise(0),
    })


def daily_gaps(df: DataFrame, key: str) -> DataFrame:
    """F3, sparse: units by day and key with the lengths of the gaps, as many rows as there are sales days."""
    daily = _daily(df, key)
    return with_gaps(daily, key, _numbered_days(daily)).drop("day_no")


def fill_gaps(gaps: DataFrame, numbered: DataFrame, key: str) -> DataFrame:
    """Every key of `with_gaps` rows on every day that occurs; days without sales are zero."""
    day = F.col("day_no")
    covered = F.sequence(day - F.col("n_before"), day + F.col("n_days") - 1)
    rows = gaps.select(key, F.col("day_no").alias("_own"), "units_sold", F.explode(covered).alias("day_no"))
    units = F.when(F.col("day_no") == F.col("_own"), F.coalesce("units_sold", F.lit(0))).otherwise(0)
    return rows.join(numbered, "day_no").select(key, "date", units.cast("long").alias("units_sold"))


def _daily(df: DataFrame, key: str) -> DataFrame:
    return known(df, "date", key).groupBy(key, "date").agg(F.sum("units_sold").alias("units_sold"))


def _dense(daily: DataFrame, key: str) -> DataFrame:
    numbered = _numbered_days(daily)
    return fill_gaps(with_gaps(daily, key, numbered), numbered, key)


def daily_by(df: DataFrame, key: str) -> DataFrame:
    """units by day and key, days without sales as zero."""
    return _dense(_daily(df, key), key)


def daily_by_top_product(df: DataFrame, n: int = 5) -> DataFrame:
    """from one daily table per product, which also ranks the products."""
    daily = _daily(df, "product_id")
    best = F.broadcast(top_keys(daily, "product_id", n).select("product_id"))  # n rows
    return _dense(daily.join(best, "product_id", "left_semi"), "product_id")


def series_panel(df: DataFrame, top_n: int = 5) -> DataFrame:
    """The series to forecast: the total, each category and the top products.

    All are built from one daily (product, category) table, which is written once: it is
    read several times here and again by every fit, while the fact is read once.
    """
    base = known(df, "date").groupBy("date", "product_id", "category").agg(F.sum("units_sold").alias("units_sold"))
    base = durable(base)

    def labelled(series: DataFrame, kind: str, name: Column) -> DataFrame:
        return series.select(F.lit(kind).alias("kind"), name.alias("series_id"), F.col("date").alias("ds"),
                             F.col("units_sold").cast("double").alias("y"))

    total = labelled(daily_totals(base), "total", F.lit("all"))
    category = labelled(daily_by(base, "category"), "category", F.col("category"))
    product = labelled(daily_by_top_product(base, top_n), "product", F.col("product_id"))
    return total.unionByName(category).unionByName(product)


def _by_series(keys: Sequence[str]) -> Window:
    """Windows over one series hold at most one row per calendar day."""
    return Window.partitionBy(*keys).orderBy("ds")


def chrono_split(panel: DataFrame, keys: Sequence[str] = SERIES, params: Params = DEFAULTS) -> DataFrame:
    """the first part of each series is for training."""
    position = F.row_number().over(_by_series(keys))
    size = F.count("*").over(Window.partitionBy(*keys))
    train = position <= F.floor(size * F.lit(params.train_fraction))
    return panel.withColumn("split", F.when(train, "train").otherwise("test"))


def store_day_split(features: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """F5 for a table of store-days: the first part in (date, store) order is for training.

    The features are written once. Rows are counted per day; the day that the cut falls into is dealt into
    ranges of stores, which are counted, and only the one range with the cut is ranked. The cut is a single
    (date, store) pair, so the split is a comparison and needs no sort. Its passes run when the function is called.
    """
    rows = durable(features, "store_days")
    cut = _nth(rows.groupBy("date").agg(F.count("*").alias("n")), "date", params.train_fraction)
    if cut is None:  # no row is for training
        return rows.withColumn("split", F.lit("test"))
    stores = rows.where(F.col("date") == F.lit(cut["date"])).select("store_id").repartitionByRange("store_id")
    ranged = durable(stores.withColumn("part", F.spark_partition_id()), "store_ranges")
    upto = F.sum("n").over(Window.orderBy("part"))  # one row per partition
    parts = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("upto", upto)
    part = parts.where(F.col("upto") >= cut["rank"]).orderBy("part").first()
    place = F.row_number().over(Window.partitionBy("part").orderBy("store_id"))  # one range
    within = ranged.where(F.col("part") == part["part"]).withColumn("place", place)
    edge = within.where(F.col("place") == cut["rank"] - part["upto"] + part["n"]).first()["store_id"]
    train = F.struct("date", "store_id") <= F.struct(F.lit(cut["date"]).alias("date"), F.lit(edge).alias("store_id"))
    return rows.withColumn("split", F.when(train, "train").otherwise("test"))


def _nth(counts: DataFrame, key: str, fraction: float) -> Row | None:
    """The key (one row each, with its count n) that the given share of all rows ends in, and the rank in it."""
    upto = F.sum("n").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cut = F.floor(F.col("total") * F.lit(fraction))
    placed = counts.withColumns({"upto": upto, "total": total})  # one row per calendar day
    found = placed.where((cut > F.col("upto") - F.col("n")) & (cut <= F.col("upto")))
    return found.select(key, (cut - F.col("upto") + F.col("n")).alias("rank")).first()


def seasonal_difference(panel: DataFrame, keys: Sequence[str] = SERIES, season: int = 7) -> DataFrame:
    """(1 - L)(1 - L^season) y, NULL until all lags exist."""
    by = _by_series(keys)
    z = F.col("y") - F.lag("y", 1).over(by) - F.lag("y", season).over(by) + F.lag("y", season + 1).over(by)
    return panel.withColumn("z", z)


def future_dates(df: DataFrame, days: int = 30, date: str = "date") -> DataFrame:
    """the days after the last one."""
    last = df.agg(F.max(date).alias("last"))
    return last.select(F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", days))).alias(date))


def forecast_metrics(scored: DataFrame, *keys: str, actual: str = "y", predicted: str = "predicted") -> DataFrame:
    """F8: errors per group; r2 is 1 - SSE/SST on the scored rows and may be negative."""
    both = known(scored, actual, predicted)
    error = F.col(actual) - F.col(predicted)
    return both.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.sum(error * error) / F.nullif(F.var_pop(actual) * F.count("*"), F.lit(0.0))).alias("r2"),
        F.avg(F.abs(error / F.nullif(F.col(actual), F.lit(0.0)))).alias("mape"),
    )


def store_day_features(df: DataFrame) -> DataFrame:
    """one row per day and store. The first weather and promotion are those of the
    smallest (product, price, units) of the day, then of the smallest value."""
    rows = known(df, "date", "store_id")

    def first(column: str) -> Column:
        order = [c for c in ("product_id", "price", "units_sold") if c != column]
        seen = F.when(F.col(column).isNotNull(), F.struct(*order, column))
        return F.min(seen)[column].alias(column)

    daily = rows.groupBy("date", "store_id").agg(
        F.sum("units_sold").alias("units_sold"),
        F.avg("inventory_level").alias("avg_inventory"),
        F.avg("price").alias("avg_price"),
        F.avg("discount").alias("avg_discount"),
        F.avg("competitor_pricing").alias("avg_competitor"),
        first("weather"),
        first("holiday_promotion"),
    )
    return daily.withColumns({
        "month": F.month("date"), "year": F.year("date"), "day": F.dayofmonth("date"),
        "weekday": F.weekday("date"), "week": F.weekofyear("date"),
    })


def lag_features(daily: DataFrame, key: str = "store_id", lags: Sequence[int] = LAGS) -> DataFrame:
    """earlier sales of the same store, counted in rows."""
    order = Window.partitionBy(key).orderBy("date")
    return daily.withColumns({f"lag_{k}": F.lag("units_sold", k).over(order) for k in lags})


def rolling_features(daily: DataFrame, key: str = "store_id", windows: Sequence[int] = WINDOWS, shift: int = 1) -> DataFrame:
    """means of full windows that end shift rows before; shift 0 includes the row itself.

    Whole units are summed up once from the first row, and a window's sum is a difference of two such sums. Differences of
    other numbers would be rounded, so these are added window by window.
    """
    order = Window.partitionBy(key).orderBy("date")
    if not isinstance(daily.schema["units_sold"].dataType, T.IntegralType):
        columns = {}
        for w in windows:
            frame = order.rowsBetween(-(w - 1) - shift, -shift)
            full = F.count("units_sold").over(frame) == w
            columns[f"rolling_{w}"] = F.when(full, F.avg("units_sold").over(frame))
        return daily.withColumns(columns)
    upto = order.rowsBetween(Window.unboundedPreceding, -shift)
    summed = daily.withColumns({"_n": F.count("units_sold").over(upto), "_sum": F.coalesce(F.sum("units_sold").over(upto), F.lit(0))})
    before = {(c, w): F.coalesce(F.lag(c, w).over(order), F.lit(0)) for c in ("_n", "_sum") for w in windows}
    return summed.withColumns({
        f"rolling_{w}": F.when(F.col("_n") - before["_n", w] == w, (F.col("_sum") - before["_sum", w]) / w) for w in windows
    }).drop("_n", "_sum")


def standardise(split: DataFrame, columns: Sequence[str]) -> DataFrame:
    """zero mean and unit population deviation over the training rows; constants stay at zero.

    The statistics are one row of fixed width and enter as a scalar subquery.
    """
    train = split.where(F.col("split") == "train")
    stats = train.agg(F.struct(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns
    ]))
    measured = split.withColumn("_train", stats.scalar())
    scaled = {}
    for c in columns:
        std = F.when(F.col(f"_train.{c}.std") == 0, 1.0).otherwise(F.col(f"_train.{c}.std"))
        scaled[c] = (F.col(c) - F.col(f"_train.{c}.mean")) / std
    return measured.withColumns(scaled).drop("_train")


def history_tail(daily: DataFrame, n: int = 90) -> DataFrame:
    """F16: the last n days of a daily series."""
    return daily.orderBy(F.desc("date")).limit(n)


def model_comparison(predictions: DataFrame) -> DataFrame:
    """scores per model over (model, ds, y, predicted) rows, the best one marked."""
    scores = forecast_metrics(predictions, "model")
    best = smallest(scores, "rmse", 1, "model").select("model").scalar()
    return scores.withColumn("best", F.col("model") == best)


def forecast_leaderboard(predictions: DataFrame) -> DataFrame:
    """the total, categories and products by increasing error, ranked within their kind."""
    scores = forecast_metrics(predictions, *SERIES)
    order = Window.partitionBy("kind").orderBy("rmse", "series_id")  # one row per series
    return scores.withColumn("rank", F.row_number().over(order))


def seasonal_naive(panel: DataFrame, keys: Sequence[str] = SERIES, season: int = 7) -> DataFrame:
    """the value one season earlier."""
    return panel.withColumn("predicted", F.lag("y", season).over(_by_series(keys)))


def naive_holdout(panel: DataFrame, last_days: int = 30, keys: Sequence[str] = SERIES, season: int = 7) -> DataFrame:
    """the last season before one cut, repeated over the last days; no held-out value takes part."""
    from_end = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ds")))
    placed = panel.withColumn("from_end", from_end)
    # The first held-out day is last_days from the end; day h takes the value of season - (h - 1) % season days before it.
    source = last_days + season - (last_days - F.col("from_end")) % season
    held = placed.where(F.col("from_end") <= last_days).withColumn("source", source)
    known_days = placed.select(*keys, F.col("from_end").alias("source"), F.col("y").alias("predicted"))
    return held.join(known_days.where(F.col("source") > last_days), [*keys, "source"]).select(*keys, "ds", "y", "predicted")
