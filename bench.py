"""Time the headline analyses; prints one JSON line.

The fact table is derived once and written as Parquet (load_fact), then every analysis
reads it from there, as a batch run would. Each time covers the whole result.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from larder.functions.columns import calendar_columns  # noqa: E402
from larder.operators import dashboard as D  # noqa: E402
from larder.operators import forecast as FC  # noqa: E402
from larder.operators import inventory as N  # noqa: E402
from larder.operators import models as M  # noqa: E402
from larder.operators import pricing as G  # noqa: E402
from larder.operators import profile as A  # noqa: E402
from larder.operators import seasonality as W  # noqa: E402
from larder.operators import supply as Y  # noqa: E402
from larder.operators import validate as Q  # noqa: E402
from larder.session import durable, fresh_path, local_session
from larder.sources.fact import read_fact_parquet, retail_view, write_fact  # noqa: E402

ANALYSES = {
    "data_understanding": [
        A.basic_info, A.duplicate_count, A.temporal_range, A.monthly_counts, A.category_counts, A.numeric_describe,
        A.correlation_matrix, A.group_means, A.category_totals, A.mean_inventory_ratio, A.mean_forecast_accuracy,
    ],
    "column_profile": [A.column_profile],
    "validation": [Q.validation_status, Q.rule_summary],
    "seasonality": [
        lambda df: W.monthly_by(df, "category"), W.seasonality_index, lambda df: W.peak_month(df, "category"),
        lambda df: W.peak_month(df, "region"), W.monthly_overall, W.yearly_monthly, W.seasonality_summary,
        W.day_of_week_sales, lambda df: W.mean_by(df, "weather"), lambda df: W.mean_by(df, "holiday_promotion"),
    ],
    "product_seasonality": [W.top_products, W.monthly_by_top_product, W.product_peak_month, W.seasonal_by_top_product],
    "supply": [
        Y.supply_status_counts, lambda df: Y.status_by(df, "category"), Y.store_supply_metrics, Y.supply_overall,
        Y.product_supply_rankings,
    ],
    "product_supply": [Y.critical_undersupply, Y.excessive_oversupply, Y.poor_forecast_products],
    "inventory": [N.inventory_params, N.product_inventory_params, N.store_top_products],
    "price_elasticity": [
        G.product_elasticity, G.category_elasticity, G.elasticity_summary, G.product_price_recommendations,
    ],
    "discount_and_competitor_analysis": [
        G.discount_units, G.discount_revenue, G.optimal_discount, G.category_optimal_discount,
        G.bucket_units, G.bucket_revenue, G.optimal_price_position, G.category_price_position,
    ],
    "daily_series": [FC.series_panel, lambda df: FC.daily_by(df, "store_id")],
    "store_day_features": [lambda df: FC.rolling_features(FC.lag_features(FC.store_day_features(df)))],
    "seasonal_forecast": [lambda df: M.seasonal_forecast(FC.series_panel(df))],
    "dashboard": [D.kpis, D.sales_trend, D.sales_by_category, D.top_products_table, D.inventory_vs_sales],
    "calendar_columns": [calendar_columns],
}

# What a group of analyses reads in place of the fact: sums that are derived from it once.
SHARED = {
    "seasonality": W.calendar_sums,
    "product_seasonality": W.product_sums,
    "product_supply": lambda df: durable(Y.product_supply_metrics(df)),
    "price_elasticity": lambda df: durable(G.product_elasticity(df)),
    "discount_and_competitor_analysis": G.price_sums,
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    scratch = fresh_path(spark, "fact")
    seconds: dict[str, float] = {}
    start = time.perf_counter()
    write_fact(retail_view(spark, folder).drop("sku"), scratch)
    seconds["load_fact"] = time.perf_counter() - start
    for name, operators in ANALYSES.items():
        start = time.perf_counter()
        rows = SHARED.get(name, lambda df: df)(read_fact_parquet(spark, scratch))
        for operator in operators:
            operator(rows).write.format("noop").mode("overwrite").save()
        seconds[name] = time.perf_counter() - start
    rounded = {name: round(value, 3) for name, value in seconds.items()}
    print(json.dumps({
        "metric": "total_seconds_of_headline_analyses", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": rounded, "sf": os.path.basename(os.path.normpath(folder)), "cores": cores,
    }))


if __name__ == "__main__":
    main()
