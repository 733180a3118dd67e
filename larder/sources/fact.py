"""Readers for the fact table: CSV, Parquet, and a view over order tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.schema import FACT_COLUMNS, FACT_FIELDS, FACT_SCHEMA


def read_fact_csv(spark: SparkSession, path: str) -> DataFrame:
    """Fact table from a CSV file with the published header, typed without inference."""
    return read_fact_raw(spark, path).select(
        *[F.expr(f"try_cast({name} AS {kind.simpleString()})").alias(name) for _, name, kind in FACT_FIELDS]
    )


def read_fact_raw(spark: SparkSession, path: str) -> DataFrame:
    """The CSV file as text under our column names, for checks on unparsed values.

    Columns are found by the names in the header, in any order; further columns are ignored, and a
    missing one is an error. All files of a folder must have the header of the first.
    """
    header = spark.read.csv(path, header=True).columns
    missing = [name for name, _, _ in FACT_FIELDS if name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    text = T.StructType([T.StructField(name, T.StringType()) for name in header])
    raw = spark.read.csv(path, schema=text, header=True, enforceSchema=False, mode="PERMISSIVE")
    return raw.select(*[F.col(f"`{name}`").alias(ours) for name, ours, _ in FACT_FIELDS])


def read_fact_parquet(spark: SparkSession, path: str, months: bool = False) -> DataFrame:
    """Fact table from Parquet; filters and column lists of later steps reach this scan.

    months keeps `month_start`, the folder of a table of write_fact, by which slices and the last day leave out folders.
    """
    if not months:
        return spark.read.schema(FACT_SCHEMA).parquet(path).select(*FACT_COLUMNS)
    schema = T.StructType([*FACT_SCHEMA.fields, T.StructField("month_start", T.DateType())])
    return spark.read.schema(schema).parquet(path).select(*FACT_COLUMNS, "month_start")


def write_fact(df: DataFrame, path: str) -> None:
    """Persist the fact table by month, for a batch of analyses.

    A folder holds the days of one month (see read_fact_parquet). The rebalance splits a month that holds most rows and merges small ones.
    """
    by_month = df.withColumn("month_start", F.trunc("date", "month"))
    by_month.hint("rebalance", "month_start").write.mode("overwrite").partitionBy("month_start").parquet(path)


def retail_view(spark: SparkSession, folder: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Fact table derived from lineitem, part, supplier, nation, region and orders.

    Each dimension is joined only when one of its columns is asked for. All joins are
    left joins on a unique key: they neither drop nor multiply fact rows, so leaving an
    unused one out does not change the result. No join carries a hint; Spark broadcasts
    a dimension while its size is below the session's threshold and shuffles it beyond.
    """
    wanted = list(columns or (*FACT_COLUMNS, "sku"))

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    view = table("lineitem")  # joins with the narrowest dimensions come first: the rows grow with each
    if "holiday_promotion" in wanted:
        urgent = table("orders").select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
        view = view.join(urgent, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "region" in wanted:
        located = (
            table("supplier")
            .join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select("s_suppkey", "r_name")
        )
        view = view.join(located, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    if {"product_id", "category", "inventory_level", "competitor_pricing"} & set(wanted):
        view = view.join(table("part"), F.col("l_partkey") == F.col("p_partkey"), "left")

    date = F.col("l_shipdate").cast("date")
    month = F.month(date)
    price = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))
    expressions = {
        "date": date,
        "store_id": F.concat(F.lit("S"), F.col("l_suppkey").cast("string")),
        "product_id": F.col("p_brand"),
        "sku": F.concat(F.lit("P"), F.col("l_partkey").cast("string")),
        "category": F.col("p_type"),
        "region": F.col("r_name"),
        "inventory_level": F.col("p_size").cast("long"),
        "units_sold": F.col("l_quantity").cast("long"),
        "units_ordered": (F.col("l_linenumber") * 5).cast("long"),
        "demand_forecast": F.col("l_quantity") * (1 + F.col("l_tax")) - 1,
        "price": price,
        "discount": F.round(F.col("l_discount") * 100).cast("int"),
        "weather": F.col("l_returnflag"),
        "holiday_promotion": F.when(F.col("urgent"), 1).otherwise(0),
        "competitor_pricing": F.col("p_retailprice"),
        "seasonality": F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .otherwise("Autumn"),
    }
    return view.select(*[expressions[name].alias(name) for name in wanted])
