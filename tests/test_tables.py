"""Operators on small hand-made tables: zero, NULL, tie, gap and edge cases."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from larder.functions.columns import net_revenue
from larder.operators import dashboard as D
from larder.operators import filters as P
from larder.operators import forecast as FC
from larder.operators import inventory as N
from larder.operators import pricing as G
from larder.operators import profile as A
from larder.operators import seasonality as W
from larder.operators import supply as Y
from larder.operators import validate as Q
from larder.params import Params
from tests.conftest import day


def dicts(df):
    return [r.asDict() for r in df.collect()]


def test_slice_is_inclusive_and_empty_means_all(fact):
    df = fact([dict(date=day(i), category="AB"[i % 2]) for i in range(6)])
    assert P.filter_slice(df, P.Slice()).count() == 6
    assert P.filter_slice(df, P.Slice(start="2024-01-02", end="2024-01-04")).count() == 3
    assert P.filter_slice(df, P.Slice(start="2024-01-02")).count() == 5
    assert P.filter_slice(df, P.Slice(categories=("A",), stores=("S1",))).count() == 3


def test_top_keys_break_ties_by_name(fact):
    df = fact([dict(product_id=p, units_sold=5) for p in ("P3", "P1", "P2")])
    assert [r["product_id"] for r in A.top_sums(df, "product_id", 2).collect()] == ["P1", "P2"]
    assert P.topn_semi(df, "product_id", 2).count() == 2


def test_latest_day_and_overview(fact):
    df = fact([dict(date=day(0), inventory_level=5), dict(date=day(3), inventory_level=7), dict(date=day(3), store_id="S2", inventory_level=2)])
    assert P.latest_day(df).count() == 2
    assert D.overview_cards(df).first().asDict() == dict(n_products=1, n_stores=2, units_sold=15, current_inventory=9)


def test_duplicates_count_repeats_and_nulls_are_equal(fact):
    df = fact([{}, {}, {}, dict(category=None), dict(category=None), dict(units_sold=6)])
    assert A.duplicate_count(df).first()[0] == 3
    turned = df.withColumns({"category": F.lit(None).cast("string"), "region": F.col("category")}).unionByName(df)
    assert A.duplicate_count(turned).first()[0] == 6


def test_describe_interpolates(fact):
    df = fact([dict(price=float(x)) for x in (1, 2, 3, 10)])
    row = {r["column_name"]: r for r in A.numeric_describe(df).collect()}["price"]
    assert (row["median"], row["mean"], row["range"]) == (2.5, 4.0, 9.0)
    assert row["std"] == pytest.approx(math.sqrt(sum((x - 4) ** 2 for x in (1, 2, 3, 10)) / 3))


def test_histogram_counts_every_row(fact):
    df = fact([dict(units_sold=u) for u in (0, 1, 5, 10, 10)])
    bins = A.histogram(df, "units_sold", 5).orderBy("bin_no").collect()
    assert [b["n"] for b in bins] == [2, 0, 1, 0, 2]
    assert sum(b["n"] for b in A.histogram(df, "units_sold").collect()) == 5
    assert [b["n"] for b in A.histogram(fact([{}, {}]), "units_sold", 3).orderBy("bin_no").collect()] == [0, 2, 0]


def test_box_whiskers_stay_inside_fences(fact):
    df = fact([dict(units_sold=u) for u in (1, 2, 3, 4, 100)])
    row = A.box_stats(df).first()
    assert (row["q1"], row["median"], row["q3"], row["low_whisker"], row["high_whisker"]) == (2.0, 3.0, 4.0, 1.0, 4.0)


def test_empty_months_are_kept(fact):
    df = fact([dict(date=datetime.date(2024, 1, 5)), dict(date=datetime.date(2024, 4, 5))])
    got = {r["month_start"].month: r["units_sold"] for r in A.monthly_totals(df).collect()}
    assert got == {1: 5, 2: 0, 3: 0, 4: 5}
    assert len(W.monthly_by(df, "category").collect()) == 12
    assert W.monthly_by(df, "category").where("avg_units IS NULL").count() == 10


def test_peak_month_tie_takes_the_first(fact):
    df = fact([dict(date=datetime.date(2024, m, 1), units_sold=u) for m, u in ((2, 9), (5, 9), (7, 1))])
    assert W.peak_month(df, "category").first()["peak_month"] == "Feb"


def test_rules_on_raw_text(spark, fact):
    good = {f: "x" for f in ("store_id", "product_id", "category", "region", "weather")}
    good.update(date="2024-01-01", price="1.5", units_sold="1", inventory_level="1", demand_forecast="1",
                discount="5", holiday_promotion="1", competitor_pricing="2", units_ordered="1", seasonality="x")
    bad = [dict(good, date="2022-13-01"), dict(good, price="-1"), dict(good, discount="101"),
           dict(good, holiday_promotion="2"), dict(good, category=""), dict(good, price="abc", category=None), good]
    df = spark.createDataFrame([tuple(r[c] for c in sorted(good)) for r in bad], ", ".join(f"{c} string" for c in sorted(good)))
    found = sorted(r["column_name"] for r in Q.rule_violations(df).collect())
    assert found == ["category", "category", "date", "discount", "holiday_promotion", "price", "price"]
    summary = {r["column_name"]: (r["n_violations"], r["passed"]) for r in Q.rule_summary(df).collect()}
    assert summary["price"] == (2, False) and summary["region"] == (0, True) and len(summary) == 13


def test_gaps_and_status(fact):
    df = fact([dict(date=day(0)), dict(date=day(0)), dict(date=day(3))])
    assert Q.date_continuity(df).first()["n_missing"] == 2
    assert sorted(r["date"] for r in Q.missing_days(df).collect()) == [day(1), day(2)]
    status = Q.validation_status(df).first()
    assert (status["n_rows"], status["n_columns"], status["n_duplicates"], status["n_missing_days"], status["passed"]) == (3, 15, 1, 2, False)
    clean = fact([dict(date=day(i)) for i in range(4)])
    assert Q.validation_status(clean).first()["passed"] is True
    assert Q.light_status(clean).first()["passed"] is True
    assert Q.light_status(fact([dict(inventory_level=-1)])).first()["passed"] is False


def test_schema_check(fact):
    df = fact([{}])
    assert Q.schema_check(df).where("NOT passed").count() == 0
    wrong = df.withColumn("price", F.col("price").cast("string")).withColumn("extra", F.lit(1)).drop("region")
    assert {r["column_name"] for r in Q.schema_check(wrong).where("NOT passed").collect()} == {"price", "extra", "region"}


def test_outlier(fact):
    df = fact([dict(price=float(p)) for p in (1, 2, 3, 4, 5, 100)])
    got = {r["column_name"]: r["n_outliers"] for r in Q.iqr_outliers(df).collect()}
    assert got["price"] == 1 and sum(got.values()) == 1


def test_status_mode_tie_and_shares(fact):
    df = fact([dict(units_sold=10, inventory_level=i) for i in (5, 12)])
    assert Y.product_supply_metrics(df).first()["supply_status"] == "Optimal"
    assert sum(r["pct"] for r in Y.status_by(df, "category").collect()) == pytest.approx(100)
    assert sum(r["n"] for r in Y.supply_status_counts(df).collect()) == 2
    unknown = fact([dict(inventory_level=None), {}])
    assert {r["supply_status"] for r in Y.status_by(unknown, "category").collect()} == {
        "Optimal", "Oversupplied", "Undersupplied", "Unknown"}


def test_stock_figures_by_hand(spark):
    # Published figures of one product in one store, and what follows from them.
    df = spark.createDataFrame([(961.1 / 7, 108.188, 100371.0, 55.0574)], "m double, s double, d double, c double")
    row = df.select(
        F.bround(N.safety_stock(F.col("s"), 7)), F.bround(N.reorder_point(F.col("m"), F.col("s"), 7)),
        F.bround(N.eoq(F.col("d"), 50, 0.25, F.col("c"))),
    ).first()
    assert tuple(row) == (471.0, 1432.0, 854.0)


def test_single_rows_and_short_years(fact):
    one = N.inventory_params(fact([{}])).first()
    assert one["demand_std"] is None and one["safety_stock"] is None and one["eoq"] is not None
    short = fact([dict(date=day(0), units_sold=10), dict(date=day(99), units_sold=10)])
    assert N.inventory_params(short).first()["annual_demand"] == pytest.approx(20 * 365 / 100)
    long = fact([dict(date=day(0), units_sold=10), dict(date=day(729), units_sold=10)])
    assert N.inventory_params(long).first()["annual_demand"] == 20.0
    assert N.inventory_params(long, always=True).first()["annual_demand"] == pytest.approx(20 * 365 / 730)


def test_price_points_need_three_usable_prices(fact):
    rows = [dict(product_id="A", price=p, units_sold=8) for p in (1.0, 2.0)]
    rows += [dict(product_id="B", price=p, units_sold=u) for p, u in ((1.0, 8), (2.0, 4), (4.0, 0))]
    rows += [dict(product_id="C", price=p, units_sold=u) for p, u in ((1.0, 8), (2.0, 4), (4.0, 2), (4.0, 2))]
    df = fact(rows)
    assert {r["product_id"] for r in G.price_points(df).collect()} == {"C"}
    row = G.product_elasticity(df).first()
    assert row["elasticity"] == pytest.approx(-1.0) and row["n_points"] == 3 and row["category"] == "Toys"
    assert G.category_elasticity(df).first()["n_products"] == 1
    curve = G.elasticity_curve(df).orderBy("step").collect()
    assert len(curve) == 100 and curve[0]["fitted_units"] == pytest.approx(8) and curve[-1]["price"] == pytest.approx(4)


def test_batches_give_the_same_tables(fact):
    rows = [dict(date=day(7 * i), category="AB"[i % 2], discount=5 * (i % 3), price=10.0 + i % 5, units_sold=i % 4 + 1,
                 product_id=f"P{i % 3}", inventory_level=i % 4) for i in range(60)]
    df = fact([*rows, dict(category=None, price=None)])

    def same(operator, shared):
        names = operator(df).columns
        left, right = (sorted((tuple(r[c] for c in names) for r in operator(x).collect()), key=repr) for x in (df, shared))
        assert len(left) == len(right) > 0
        for a, b in zip(left, right):
            assert all(x == pytest.approx(y) if isinstance(x, float) else x == y for x, y in zip(a, b))

    calendar = W.calendar_sums(df)
    for operator in (W.seasonality_summary, W.day_of_week_sales, lambda x: W.peak_month(x, "category")):
        same(operator, calendar)
    same(W.product_peak_month, W.product_sums(df))
    prices = G.price_sums(df)
    for operator in (G.category_optimal_discount, G.bucket_units, G.bucket_revenue):
        same(operator, prices)
    same(Y.critical_undersupply, Y.product_supply_metrics(df))
    same(G.product_price_recommendations, G.product_elasticity(df))


def test_first_category_is_the_earliest(fact):
    df = fact([dict(date=day(1), category="A"), dict(date=day(0), store_id="S2", category="B"), dict(date=day(0), category="C")])
    assert G.product_category(df).first()["category"] == "C"


def test_empty_buckets_and_best_discount(fact):
    df = fact([dict(price=10.0, competitor_pricing=10.0), dict(price=30.0, competitor_pricing=10.0)])
    buckets = G.bucket_revenue(df).orderBy("bucket_no").collect()
    assert len(buckets) == 8 and [b["bucket_no"] for b in buckets if b["avg_revenue"] is not None] == [3]
    assert G.optimal_price_position(df).first()["bucket"] == "-2% to 0%"
    tie = fact([dict(discount=d) for d in (5, 0)])
    assert G.category_optimal_discount(tie.withColumn("price", 10 / (1 - F.col("discount") / 100))).first()["discount"] in (0, 5)
    assert G.optimal_discount(fact([dict(discount=0), dict(discount=0)])).first()["discount"] == 0
    assert fact([dict(price=10.0, units_sold=3, discount=20)]).select(net_revenue()).first()[0] == pytest.approx(24.0)


def test_dense_days(fact):
    df = fact([dict(date=day(0), category="A"), dict(date=day(2), category="B"), dict(date=day(2), category=None)])
    got = {(r["category"], r["date"]): r["units_sold"] for r in FC.daily_by(df, "category").collect()}
    assert got == {("A", day(0)): 5, ("A", day(2)): 0, ("B", day(0)): 0, ("B", day(2)): 5}


def test_gaps_stand_for_days_without_sales(fact):
    df = fact([dict(date=day(i), store_id=s, units_sold=i) for s, i in [("a", 2), ("a", 5), ("b", 0), ("b", 9), ("c", 3)]]
              + [dict(date=None, store_id="a"), dict(date=day(2), store_id=None)])
    got = {(r["store_id"], r["date"]): (r["units_sold"], r["n_days"], r["n_before"]) for r in FC.daily_gaps(df, "store_id").collect()}
    days = sorted({d for _, d in got})
    assert [got["a", days[k]] for k in (1, 3)] == [(2, 2, 1), (5, 2, 0)]
    assert [got["b", days[k]] for k in (0, 4)] == [(0, 4, 0), (9, 1, 0)] and got["c", days[2]] == (3, 3, 2) and len(got) == 5
    filled = FC.daily_by(df, "store_id").collect()
    assert len(filled) == len({(r["store_id"], r["date"]) for r in filled}) == 15
    assert {(r["store_id"], r["date"]): r["units_sold"] for r in filled if r["units_sold"]} == {k: v[0] for k, v in got.items() if v[0]}
    assert FC.daily_by(df.limit(0), "store_id").count() == FC.daily_gaps(df.limit(0), "store_id").count() == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_split_of_one_day_with_many_stores(spark, fact, partitions):
    rows = fact([dict(date=day(1), store_id=f"S{k}", units_sold=k) for k in range(60)] + [dict(date=day(0), store_id="S1")])
    rows = rows.select("date", "store_id", "units_sold")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        split = FC.store_day_split(rows).orderBy("date", "store_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r["split"] for r in split] == ["train"] * int(61 * 0.8) + ["test"] * (61 - int(61 * 0.8))
    assert [r["split"] for r in FC.store_day_split(rows.limit(1)).collect()] == ["test"]
    assert FC.store_day_split(rows.limit(0)).count() == 0


def test_store_day_split_is_the_first_part(fact):
    df = fact([dict(date=day(i // 3), store_id=f"S{i % 3}") for i in range(11)]).select("date", "store_id")
    split = FC.store_day_split(df).orderBy("date", "store_id").collect()
    assert [r["split"] for r in split] == ["train"] * 8 + ["test"] * 3


def test_lags_and_windows_count_rows(fact):
    df = fact([dict(date=day(i), units_sold=i) for i in range(10)]).select("date", "store_id", "units_sold")
    rows = FC.rolling_features(FC.lag_features(df, lags=[1]), windows=[3]).orderBy("date").collect()
    assert [r["lag_1"] for r in rows][:3] == [None, 0, 1]
    assert [r["rolling_3"] for r in rows][:5] == [None, None, None, 1.0, 2.0]
    same_day = FC.rolling_features(df, windows=[3], shift=0).orderBy("date").collect()
    assert [r["rolling_3"] for r in same_day][:4] == [None, None, 1.0, 2.0]


def test_scores(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (0.0, None)], "y double, predicted double")
    row = FC.forecast_metrics(df).first()
    assert (row["n"], row["mae"], row["r2"], row["mape"]) == (2, 0.5, 0.5, 0.5)


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([("train", 2.0, 1.0), ("train", 2.0, 3.0), ("test", 2.0, 5.0)], "split string, a double, b double")
    assert [(r["a"], r["b"]) for r in FC.standardise(df, ["a", "b"]).collect()] == [(0.0, -1.0), (0.0, 1.0), (0.0, 3.0)]


def test_params_from_json(tmp_path):
    path = tmp_path / "config.json"
    path.write_text('{"inventory_optimization": {"lead_time_days": 3}, "pricing_strategy": {"price_diff_bins": [-1, 0, 1]}, '
                    '"forecasting": {"sarima_params": {"order": [2, 1, 0], "seasonal_order": [0, 1, 1, 14]}}}')
    params = Params.from_json(str(path))
    assert params.lead_time_days == 3 and params.price_diff_bins == (-1, 0, 1) and params.service_level == 0.95
    assert params.order == (2, 1, 0) and params.seasonal_order == (0, 1, 1, 14)
