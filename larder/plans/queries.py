"""The registered queries: one per operator, each over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions import columns as C
from larder.functions import regression
from larder.operators import dashboard as D
from larder.operators import filters as P
from larder.operators import forecast as FC
from larder.operators import inventory as N
from larder.operators import models as M
from larder.operators import pricing as G
from larder.operators import profile as A
from larder.operators import report as R
from larder.operators import seasonality as W
from larder.operators import supply as Y
from larder.operators import validate as Q
from larder.params import DEFAULTS
from larder.schema import CATEGORICAL_COLUMNS, FACT_COLUMNS, FACT_FIELDS, NUMERIC_COLUMNS
from larder.session import durable, fresh_path
from larder.sources import results as S
from larder.sources.fact import read_fact_csv, read_fact_parquet, retail_view, write_fact

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 1_000_000.0
OFF_CENTRE = 0.00037


def comparable(df: DataFrame) -> DataFrame:
    """Round doubles to six decimals, so that the order of a sum does not show.

    The rounding border is moved a little off the centre, because decimal data puts exact
    values on the centre. The oracle does the same arithmetic.
    """
    return df.select(*[
        (F.rint(F.col(f.name) * DIGITS + OFF_CENTRE) / DIGITS).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema
    ])


def _over(columns: str | tuple[str, ...], operator: Callable[[DataFrame], DataFrame]) -> Query:
    """An operator over the retail view, of which only the named columns are built."""
    names = columns.split() if isinstance(columns, str) else list(columns)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return comparable(operator(retail_view(spark, folder, names)))

    return run


def _derived(columns: str, **expressions) -> Query:
    """Row-level expressions beside the columns they come from."""
    return _over(columns, lambda df: df.withColumns({k: make() for k, make in expressions.items()}))


def damaged(df: DataFrame) -> DataFrame:
    """The retail view with values out of range, for the checks: the test tables hold none."""
    return df.withColumns({
        "category": F.when(F.col("units_sold") == 7, F.lit(None)).otherwise(F.col("category")),
        "demand_forecast": F.col("demand_forecast") - 10,
        "discount": (F.col("discount") * 11).cast("int"),
        "holiday_promotion": (F.col("holiday_promotion") * F.col("units_sold")).cast("int"),
    })


# A dashboard selection for the sliced tables.
CHOSEN = P.Slice(start="1996-01-01", end="1999-12-31", categories=("ECONOMY", "STANDARD"), regions=("ASIA", "EUROPE"))

CHOSEN_PRODUCTS = replace(CHOSEN, products=("Brand#11", "Brand#12"))

SUPPLY = "product_id category inventory_level units_sold demand_forecast"
STOCK = "date product_id store_id units_sold price"
PRICES = "date product_id store_id category units_sold price"
REVENUE = "units_sold price discount"
POSITION = "category units_sold price discount competitor_pricing"
STORE_DAY = "date store_id product_id units_sold inventory_level price discount competitor_pricing weather holiday_promotion"
PANEL = "date product_id category units_sold"
SEASONAL_WALK = replace(DEFAULTS, order=(0, 1, 0), seasonal_order=(0, 1, 0, 7))  # no coefficients, so SQL can state it
AIRLINE = replace(DEFAULTS, order=(0, 1, 1), seasonal_order=(0, 1, 1, 7))
KPI = "date category store_id region product_id units_sold inventory_level demand_forecast"

_fits: dict[tuple, M.ForestFit] = {}


def forest(spark: SparkSession, folder: str) -> M.ForestFit:
    """The fitted forest of a folder; F13-F15 and R1 share one training run per session and state of the data."""
    rows = retail_view(spark, folder, STORE_DAY.split())
    seen = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, folder, *seen)
    if key not in _fits:
        _fits[key] = M.random_forest_forecast(rows)
    return _fits[key]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return A.duplicate_count(spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang"))


def _pruned(operator: Callable[[DataFrame], DataFrame]) -> Query:
    """An operator over the fact written by month and read with its months."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = fresh_path(spark, "fact_by_month")
        write_fact(retail_view(spark, folder, FACT_COLUMNS), path)
        return comparable(operator(read_fact_parquet(spark, path, months=True)))
    return run


def _csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Write the fact as CSV with its columns turned round, and read it by their names."""
    path = fresh_path(spark, "fact_csv")
    view = retail_view(spark, folder, FACT_COLUMNS)
    view.select(*[F.col(ours).alias(header) for header, ours, _ in reversed(FACT_FIELDS)]).write.csv(path, header=True)
    return comparable(read_fact_csv(spark, path))


def _parquet_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "fact_parquet")
    write_fact(retail_view(spark, folder, FACT_COLUMNS), path)
    return comparable(read_fact_parquet(spark, path))


def _json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Write a result as JSON into the shared folder and read it back."""
    result = Y.supply_status_counts(retail_view(spark, folder, ["inventory_level", "units_sold"]))
    path = fresh_path(spark, "supply_status")
    S.write_json(result, path)
    return comparable(S.read_results(spark, path, result.schema))


def _read_results(spark: SparkSession, folder: str) -> DataFrame:
    """An earlier result together with a missing one, which counts as empty."""
    found = _json_round_trip(spark, folder)
    missing = S.read_results(spark, fresh_path(spark, "none"), found.schema)
    return found.unionByName(missing)


def _run_stats(spark: SparkSession, folder: str) -> DataFrame:
    return S.run_stats(retail_view(spark, folder, FACT_COLUMNS))


def _forest_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return FC.forecast_metrics(forest(spark, folder).predictions())


def _total(spark: SparkSession, folder: str) -> DataFrame:
    return FC.series_panel(retail_view(spark, folder, PANEL.split())).where(F.col("kind") == "total")


def _naive_from_cut(spark: SparkSession, folder: str) -> DataFrame:
    return comparable(FC.naive_holdout(_total(spark, folder)))


def _comparison(spark: SparkSession, folder: str, days: int = 30) -> DataFrame:
    """All forecasters on the last days of the total, each fitted before the same cut and run over the same horizon."""
    panel = durable(_total(spark, folder), "total_series")
    models = {
        "seasonal_naive": FC.naive_holdout(panel, days), "seasonal_ar": M.seasonal_holdout(panel, last_days=days),
        "regression": M.regression_holdout(panel, last_days=days), "random_forest": M.forest_holdout(panel, last_days=days),
    }
    named = [scored.select(F.lit(name).alias("model"), "ds", "y", "predicted") for name, scored in models.items()]
    return FC.model_comparison(reduce(DataFrame.unionByName, named))


def _normal_sums(df: DataFrame) -> DataFrame:
    """All sums of products that the regression of F17 is solved from, one row each."""
    sums = regression.sums_of_products(M.regression_series(FC.series_panel(df)), FC.SERIES)
    return sums.select(*FC.SERIES, F.posexplode("sums").alias("pair", "total"))


def _naive_scores(df: DataFrame) -> DataFrame:
    panel = FC.chrono_split(FC.seasonal_naive(FC.series_panel(df)))
    return panel.where(F.col("split") == "test")


def _naive_report(df: DataFrame) -> DataFrame:
    total = FC.seasonal_naive(FC.daily_totals(df).select(
        F.lit("total").alias("kind"), F.lit("all").alias("series_id"), F.col("date").alias("ds"),
        F.col("units_sold").cast("double").alias("y")))
    scores = FC.forecast_metrics(FC.chrono_split(total).where(F.col("split") == "test"))
    return R.key_metrics(df, scores, model="naive_forecast_r2")


def _forest_report(spark: SparkSession, folder: str) -> DataFrame:
    df = retail_view(spark, folder, ("date " + SUPPLY + " price").split())
    return comparable(R.key_metrics(df, _forest_metrics(spark, folder)))


def _standardised(df: DataFrame) -> DataFrame:
    numbers = ["avg_inventory", "avg_price", "avg_discount", "avg_competitor"]
    split = FC.store_day_split(FC.store_day_features(df))
    return FC.standardise(split, numbers).select("date", "store_id", "split", *numbers)


def _windows(**options) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        daily = df.groupBy("date", "store_id").agg(F.sum("units_sold").alias("units_sold"))
        return FC.rolling_features(daily, **options)
    return run


def _lags(df: DataFrame) -> DataFrame:
    daily = df.groupBy("date", "store_id").agg(F.sum("units_sold").alias("units_sold"))
    return FC.lag_features(daily).select("date", "store_id", "units_sold", *[
        F.col(f"lag_{k}").cast("double").alias(f"lag_{k}") for k in FC.LAGS])


def _complete(df: DataFrame) -> DataFrame:
    return P.drop_incomplete(FC.rolling_features(_lags(df)))


def _log_transform(df: DataFrame) -> DataFrame:
    log_price, log_quantity = C.log_transform(F.col("price"), F.col("units_sold"))
    return df.withColumns({"log_price": log_price, "log_quantity": log_quantity})


def _bucketed(df: DataFrame) -> DataFrame:
    number = C.price_bucket_no(C.price_difference_pct())
    return df.select("price", "competitor_pricing", F.coalesce(number, F.lit(-1)).alias("bucket_no"),
                     C.price_bucket_label(number).alias("bucket"))


def _product_advice(df: DataFrame) -> DataFrame:
    fits = G.product_elasticity(df)
    return fits.select("product_id", "elasticity", "avg_price",
                       C.product_price_action(F.col("elasticity"), F.col("avg_price")).alias("recommendation"))


def _category_advice(df: DataFrame) -> DataFrame:
    fits = G.category_elasticity(df)
    return fits.select("category", "elasticity", C.category_price_action(F.col("elasticity")).alias("recommendation"))


def _labelled(tables: dict[str, DataFrame], value: str) -> DataFrame:
    """Tables of different keys in one long form: table, label, value."""
    parts = [
        table.select(F.lit(name).alias("table_name"), F.concat_ws("|", *[F.col(c).cast("string") for c in table.columns if c != value]).alias("label"),
                     F.col(value).alias("value")) for name, table in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _from_calendar_sums(df: DataFrame) -> DataFrame:
    """Several seasonality tables of a batch, all from one pass over the fact."""
    sums = W.calendar_sums(df)
    return _labelled({
        "monthly_by_category": W.monthly_by(sums, "category"),
        "monthly_by_region": W.monthly_by(sums, "region"),
        "weather": W.mean_by(sums, "weather"),
        "promotion": W.mean_by(sums, "holiday_promotion"),
        "season_category": W.mean_by(sums, "seasonality", "category"),
        "day_of_week": W.day_of_week_sales(sums),
    }, "avg_units")


def _from_price_sums(df: DataFrame) -> DataFrame:
    """The discount and price-position tables of a batch, all from one pass over the fact."""
    sums = G.price_sums(df)
    return _labelled({
        "discount": G.discount_revenue(sums),
        "category_discount": G.category_discount_revenue(sums),
        "optimal_discount": G.optimal_discount(sums),
        "bucket": G.bucket_revenue(sums),
        "category_bucket": G.category_bucket_revenue(sums),
        "category_position": G.category_price_position(sums),
    }, "avg_revenue")


SUPPLY_COLUMNS = "inventory_level units_sold demand_forecast"

QUERIES: dict[str, Query] = {
    # Sources and sinks
    "s1_read_fact": _over((*FACT_COLUMNS, "sku"), lambda df: df),
    "s1_read_fact_csv": _csv_round_trip,
    "s1_read_fact_parquet": _parquet_round_trip,
    "s2_write_json": _json_round_trip,
    "s3_read_results": _read_results,
    "s4_sample_rows": _over("price units_sold inventory_level category", S.sample_rows),
    "s5_run_stats": _run_stats,
    # Projections
    "c1_calendar_columns": _over("date store_id", C.calendar_columns),
    "c2_inventory_sales_ratio": _derived("inventory_level units_sold", ratio=C.inventory_sales_ratio),
    "c3_sell_through_rate": _derived("inventory_level units_sold", rate=C.sell_through_rate),
    "c4_forecast_accuracy": _derived("demand_forecast units_sold", accuracy=C.forecast_accuracy),
    "c5_supply_gap": _derived("inventory_level units_sold", gap=C.supply_gap),
    "c6_optimal_inventory": _derived("units_sold", optimal=C.optimal_inventory),
    "c7_supply_status": _derived("inventory_level units_sold", status=C.supply_status),
    "c8_net_revenue": _derived("price units_sold discount", revenue=C.net_revenue),
    "c9_price_difference": _derived("price competitor_pricing", difference=C.price_difference, pct=C.price_difference_pct),
    "c10_price_diff_bucket": _over("price competitor_pricing", _bucketed),
    "c11_clip": _derived("inventory_level units_sold", clipped=lambda: C.clip(C.inventory_sales_ratio(), 0.0, 10.0)),
    "c12_one_hot": _over("date store_id weather", lambda df: C.one_hot(df, "weather", ["A", "N", "R"])),
    "c13_log_transform": _over("price units_sold", _log_transform),
    "c14_recode_flag": _derived("date holiday_promotion", promotion=lambda: C.recode_flag(F.col("holiday_promotion"))),
    "c15_category_price_action": _over(PRICES, _category_advice),
    "c16_product_price_action": _over(PRICES, _product_advice),
    # Filters
    "p1_filter_slice_pruned": _pruned(lambda df: P.filter_slice(df, CHOSEN).drop("month_start")),
    "p3_latest_day_pruned": _pruned(lambda df: P.latest_day(df).drop("month_start")),
    "p1_filter_slice": _over(KPI, lambda df: P.filter_slice(df, CHOSEN)),
    "p2_topn_semi": _over("date product_id store_id units_sold", lambda df: P.topn_semi(df, "product_id", 10)),
    "p2_topn_semi_sku": _over("date sku store_id units_sold", lambda df: P.topn_semi(df, "sku", 10)),
    "p3_latest_day": _over("date store_id product_id units_sold inventory_level", P.latest_day),
    "p4_poor_forecast_rows": _over("date store_id units_sold demand_forecast", P.poor_forecast_rows),
    "p4_poor_forecast_head": _over(FACT_COLUMNS, P.poor_forecast_head),
    "p5_status_head": _over(FACT_COLUMNS, lambda df: P.status_head(df, "Undersupplied")),
    "p6_drop_incomplete": _over("date store_id units_sold", _complete),
    "p7_positive_points": _over("date product_id price units_sold", P.positive_points),
    "p8_filter_options": _over("date category store_id region product_id", P.filter_options),
    # Profiling
    "a1_basic_info": _over(FACT_COLUMNS, A.basic_info),
    "a2_null_counts": _over(FACT_COLUMNS, lambda df: A.null_counts(damaged(df))),
    "a3_duplicate_count": _over(FACT_COLUMNS, A.duplicate_count),
    "a3_duplicate_count_documents": _documents,
    "a4_temporal_range": _over("date", A.temporal_range),
    "a5_monthly_counts": _over("date", A.monthly_counts),
    "a6_category_counts": _over(CATEGORICAL_COLUMNS, A.category_counts),
    "a7_numeric_describe": _over(NUMERIC_COLUMNS, A.numeric_describe),
    "a8_summary_stats": _over(NUMERIC_COLUMNS, A.summary_stats),
    "a9_correlation_matrix": _over(NUMERIC_COLUMNS, A.correlation_matrix),
    "a10_pair_correlation": _over("price units_sold", A.pair_correlation),
    "a11_group_means": _over((*A.GROUPED_DIMENSIONS, *NUMERIC_COLUMNS), A.group_means),
    "a12_top_products": _over("product_id units_sold", lambda df: A.top_sums(df, "product_id")),
    "a12_top_stores": _over("store_id units_sold", lambda df: A.top_sums(df, "store_id")),
    "a13_category_totals": _over("category units_sold", A.category_totals),
    "a14_mean_by_discount": _over("discount units_sold", lambda df: A.mean_by_dimension(df, "discount")),
    "a14_mean_by_season": _over("seasonality units_sold", lambda df: A.mean_by_dimension(df, "seasonality")),
    "a14_mean_by_weather": _over("weather units_sold", lambda df: A.mean_by_dimension(df, "weather")),
    "a15_mean_inventory_ratio": _over("inventory_level units_sold", A.mean_inventory_ratio),
    "a16_mean_forecast_accuracy": _over("demand_forecast units_sold", A.mean_forecast_accuracy),
    "a17_histogram": _over("units_sold", lambda df: A.histogram(df, "units_sold")),
    "a17_ratio_histogram": _over("inventory_level units_sold", A.ratio_histogram),
    "a18_box_stats": _over("category units_sold", A.box_stats),
    "a19_monthly_totals": _over("date units_sold", A.monthly_totals),
    "a20_column_profile": _over(FACT_COLUMNS, A.column_profile),
    # Validation
    "q1_missing_report": _over(FACT_COLUMNS, lambda df: Q.missing_report(damaged(df))),
    "q2_negative_report": _over(FACT_COLUMNS, Q.negative_report),
    "q2_negative_report_damaged": _over(FACT_COLUMNS, lambda df: Q.negative_report(damaged(df))),
    "q3_rule_violations": _over(FACT_COLUMNS, Q.rule_violations),
    "q3_rule_violations_damaged": _over(FACT_COLUMNS, lambda df: Q.rule_violations(damaged(df))),
    "q4_rule_summary": _over(FACT_COLUMNS, Q.rule_summary),
    "q4_rule_summary_damaged": _over(FACT_COLUMNS, lambda df: Q.rule_summary(damaged(df))),
    "q6_iqr_outliers": _over(Q.OUTLIER_COLUMNS, Q.iqr_outliers),
    "q7_date_continuity": _over("date", Q.date_continuity),
    "q7_missing_days": _over("date", Q.missing_days),
    "q8_validation_status": _over(FACT_COLUMNS, Q.validation_status),
    "q8_validation_status_damaged": _over(FACT_COLUMNS, lambda df: Q.validation_status(damaged(df))),
    "q9_light_status": _over(FACT_COLUMNS, Q.light_status),
    # Seasonality
    "w1_monthly_by_category": _over("date category units_sold", lambda df: W.monthly_by(df, "category")),
    "w2_category_peak_month": _over("date category units_sold", lambda df: W.peak_month(df, "category")),
    "w3_category_seasonality_index": _over("date category units_sold", W.seasonality_index),
    "w4_top10_products": _over("product_id units_sold", W.top_products),
    "w5_monthly_by_top_product": _over("date product_id units_sold", W.monthly_by_top_product),
    "w6_product_peak_month": _over("date product_id units_sold", W.product_peak_month),
    "w7_monthly_by_region": _over("date region units_sold", lambda df: W.monthly_by(df, "region")),
    "w8_region_peak_month": _over("date region units_sold", lambda df: W.peak_month(df, "region")),
    "w9_monthly_overall": _over("date units_sold", W.monthly_overall),
    "w10_weather_impact": _over("weather units_sold", lambda df: W.mean_by(df, "weather")),
    "w11_promotion_impact": _over("holiday_promotion units_sold", lambda df: W.mean_by(df, "holiday_promotion")),
    "w12_yearly_monthly": _over("date units_sold", W.yearly_monthly),
    "w13_seasonality_summary": _over("date category weather units_sold", W.seasonality_summary),
    "w14_seasonal_by_category": _over("seasonality category units_sold", lambda df: W.mean_by(df, "seasonality", "category")),
    "w15_top_category_by_season": _over("seasonality category units_sold", lambda df: W.top_by_season(df, "category")),
    "w16_seasonal_by_top_product": _over("seasonality product_id units_sold", W.seasonal_by_top_product),
    "w17_high_variance_products": _over("product_id units_sold", W.high_variance_products),
    "w18_seasonal_by_region": _over("seasonality region units_sold", lambda df: W.mean_by(df, "seasonality", "region")),
    "w18_best_region_by_season": _over("seasonality region units_sold", lambda df: W.top_by_season(df, "region")),
    "w19_seasonal_overall": _over("seasonality units_sold", lambda df: W.mean_by(df, "seasonality")),
    "w20_day_of_week_sales": _over("date units_sold", W.day_of_week_sales),
    "w1_w20_from_sums": _over("date category region weather holiday_promotion seasonality units_sold", _from_calendar_sums),
    # Supply
    "y1_supply_status_counts": _over("inventory_level units_sold", Y.supply_status_counts),
    "y2_status_by_category": _over("category inventory_level units_sold", lambda df: Y.status_pivot(df, "category")),
    "y3_status_pct_by_category": _over("category inventory_level units_sold", lambda df: Y.status_by(df, "category")),
    "y4_product_supply_metrics": _over(SUPPLY, Y.product_supply_metrics),
    "y5_critical_undersupply": _over(SUPPLY, Y.critical_undersupply),
    "y6_excessive_oversupply": _over(SUPPLY, Y.excessive_oversupply),
    "y7_store_supply_metrics": _over("store_id " + SUPPLY_COLUMNS, Y.store_supply_metrics),
    "y8_supply_overall": _over(SUPPLY_COLUMNS, Y.supply_overall),
    "y9_category_gap_extremes": _over("category inventory_level units_sold", Y.category_gap_extremes),
    "y10_category_supply_metrics": _over("category " + SUPPLY_COLUMNS, Y.category_supply_metrics),
    "y11_product_supply_rankings": _over(SUPPLY, Y.product_supply_rankings),
    "y12_store_status_distribution": _over("store_id inventory_level units_sold", lambda df: Y.status_by(df, "store_id")),
    "y12_store_sums": _over("store_id inventory_level units_sold", Y.store_sums),
    "y13_poor_forecast_products": _over(SUPPLY, Y.poor_forecast_products),
    # Inventory
    "n1_demand_stats": _over(STOCK, N.demand_stats),
    "n2_annualised_demand": _over(STOCK, lambda df: N.annualised_demand(N.demand_stats(df), df, always=True)),
    "n3_safety_stock": _over(STOCK, lambda df: N.unrounded_params(df).select(*N.KEYS, "safety_stock")),
    "n4_reorder_point": _over(STOCK, lambda df: N.unrounded_params(df).select(*N.KEYS, "reorder_point")),
    "n5_eoq": _over(STOCK, lambda df: N.unrounded_params(df).select(*N.KEYS, "eoq")),
    "n6_inventory_params": _over(STOCK, N.inventory_params),
    "n6_inventory_params_sku": _over(
        "date sku store_id units_sold price", lambda df: N.inventory_params(df, keys=("sku", "store_id"))),
    "n7_product_inventory_params": _over(STOCK, N.product_inventory_params),
    "n8_top10_inventory_products": _over(STOCK, N.top_inventory_products),
    "n9_store_top5_products": _over(STOCK, N.store_top_products),
    "n10_inventory_lookup": _over(STOCK, lambda df: N.inventory_lookup(df, "Brand#1")),
    # Pricing
    "g1_price_points": _over("product_id price units_sold", G.price_points),
    "g2_product_elasticity": _over(PRICES, G.product_elasticity),
    "g2_sku_elasticity": _over("date sku store_id category units_sold price", lambda df: G.product_elasticity(df, "sku")),
    "g3_product_category": _over("date product_id store_id category", G.product_category),
    "g4_category_elasticity": _over(PRICES, G.category_elasticity),
    "g4_category_elasticity_sku": _over(
        "date sku store_id category units_sold price", lambda df: G.category_elasticity(df, "sku")),
    "g5_elasticity_summary": _over("product_id price units_sold", G.elasticity_summary),
    "g6_elasticity_curve": _over("product_id price units_sold", G.elasticity_curve),
    "g7_discount_units": _over("discount units_sold", G.discount_units),
    "g8_discount_revenue": _over(REVENUE, G.discount_revenue),
    "g9_optimal_discount": _over(REVENUE, G.optimal_discount),
    "g10_category_discount_revenue": _over("category " + REVENUE, G.category_discount_revenue),
    "g10_category_optimal_discount": _over("category " + REVENUE, G.category_optimal_discount),
    "g11_bucket_units": _over(POSITION, G.bucket_units),
    "g12_bucket_revenue": _over(POSITION, G.bucket_revenue),
    "g13_optimal_price_position": _over(POSITION, G.optimal_price_position),
    "g14_category_bucket_revenue": _over(POSITION, G.category_bucket_revenue),
    "g14_category_price_position": _over(POSITION, G.category_price_position),
    "g15_category_price_recommendations": _over(PRICES, G.category_price_recommendations),
    "g16_product_price_recommendations": _over("product_id price units_sold", G.product_price_recommendations),
    "g7_g14_from_sums": _over(POSITION, _from_price_sums),
    # Forecasting
    "f1_daily_totals": _over("date units_sold", FC.daily_totals),
    "f2_daily_by_category": _over("date category units_sold", lambda df: FC.daily_by(df, "category")),
    "f3_daily_by_store": _over("date store_id units_sold", lambda df: FC.daily_by(df, "store_id")),
    "f3_daily_gaps": _over("date store_id units_sold", lambda df: FC.daily_gaps(df, "store_id")),
    "f4_daily_by_top_product": _over("date product_id units_sold", FC.daily_by_top_product),
    "f5_chrono_split": _over(PANEL, lambda df: FC.chrono_split(FC.series_panel(df))),
    "f5_store_day_split": _over("date store_id units_sold", lambda df: FC.store_day_split(
        df.groupBy("date", "store_id").agg(F.sum("units_sold").alias("units_sold")))),
    "f6_seasonal_difference": _over(PANEL, lambda df: FC.seasonal_difference(FC.series_panel(df))),
    "f6_seasonal_forecast": _over(PANEL, lambda df: M.seasonal_forecast(FC.series_panel(df))),
    "f6_seasonal_walk": _over(PANEL, lambda df: M.seasonal_forecast(FC.series_panel(df), SEASONAL_WALK)),
    "f6_seasonal_moving_average": _over(PANEL, lambda df: M.seasonal_forecast(FC.series_panel(df), AIRLINE)),
    "f7_future_dates": _over("date", FC.future_dates),
    "f8_forecast_metrics": _over(PANEL, lambda df: FC.forecast_metrics(_naive_scores(df), *FC.SERIES)),
    "f9_store_day_features": _over(STORE_DAY, FC.store_day_features),
    "f10_lag_features": _over("date store_id units_sold", _lags),
    "f11_rolling_features": _over("date store_id units_sold", _windows(shift=1)),
    "f11_rolling_features_same_day": _over("date store_id units_sold", _windows(shift=0)),
    "f12_standardise": _over(STORE_DAY, _standardised),
    "f13_random_forest_forecast": _forest_metrics,
    "f14_feature_importance": lambda spark, folder: forest(spark, folder).importance(),
    "f15_actual_vs_predicted": lambda spark, folder: forest(spark, folder).predictions(),
    "f16_history_tail": _over("date units_sold", lambda df: FC.history_tail(FC.daily_totals(df))),
    "f17_regression_forecast": _over(
        PANEL, lambda df: M.regression_forecast(M.regression_series(FC.series_panel(df)))),
    "f17_normal_sums": _over(PANEL, _normal_sums),
    "f18_model_comparison": _comparison,
    "f18_naive_from_cut": _naive_from_cut,
    "f19_forecast_leaderboard": _over(
        PANEL, lambda df: FC.forecast_leaderboard(M.seasonal_holdout(FC.series_panel(df)))),
    "f19_naive_leaderboard": _over(PANEL, lambda df: FC.forecast_leaderboard(_naive_scores(df))),
    "f20_seasonal_naive": _over(PANEL, lambda df: FC.seasonal_naive(FC.series_panel(df))),
    # Dashboard and report
    "d1_kpis": _over(KPI, D.kpis),
    "d1_kpis_sliced": _over(KPI, lambda df: D.kpis(df, CHOSEN)),
    "d2_sales_trend": _over("date units_sold", D.sales_trend),
    "d3_sales_by_category": _over("category units_sold", D.sales_by_category),
    "d4_top_products_table": _over(
        "product_id category units_sold inventory_level price discount", D.top_products_table),
    "d5_inventory_vs_sales": _over("date inventory_level units_sold", D.inventory_vs_sales),
    "d2_sales_trend_sliced": _over(KPI, lambda df: D.sales_trend(df, CHOSEN_PRODUCTS)),
    "d3_sales_by_category_sliced": _over(KPI, lambda df: D.sales_by_category(df, CHOSEN_PRODUCTS)),
    "d4_top_products_table_sliced": _over(
        KPI + " price discount", lambda df: D.top_products_table(df, CHOSEN_PRODUCTS)),
    "d5_inventory_vs_sales_sliced": _over(KPI, lambda df: D.inventory_vs_sales(df, CHOSEN_PRODUCTS)),
    "d6_overview_cards": _over("date product_id store_id units_sold inventory_level", D.overview_cards),
    "d7_data_overview": _over("date store_id product_id category region", D.data_overview),
    "r1_key_metrics": _forest_report,
    "r1_naive_metrics": _over("date " + SUPPLY + " price", _naive_report),
    "r2_key_insights": _over(
        "seasonality region category inventory_level units_sold demand_forecast price discount competitor_pricing",
        R.key_insights),
}
