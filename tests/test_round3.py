"""Medians of fitted values, profiles and checks over a fact that is joined once, and the forest's deep levels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions import forest
from larder.operators import pricing as G
from larder.operators import profile as A
from larder.operators import validate as Q


def test_slopes_that_differ_by_pass_have_a_median(spark):
    """A slope's last digits depend on the order in which partial sums meet; here they differ whenever it is found."""
    near = F.udf(lambda x: x + random.random() * 1e-6, "double").asNondeterministic()
    slopes = spark.createDataFrame([(c, k / 10) for c in "ab" for k in range(-9, 0)], "category string, elasticity double")
    fits = slopes.withColumns({"elasticity": near("elasticity"), "elastic_status": F.lit("")})
    found = {r.category: r for r in G.category_elasticity(fits).collect()}
    assert {c: r.n_products for c, r in found.items()} == {"a": 9, "b": 9}
    assert [r.elasticity for r in found.values()] == pytest.approx([-0.5, -0.5], abs=1e-5)


def test_forest_grows_the_same_subtrees_in_groups(spark):
    """Nodes that are split over all rows and nodes that are grown in a group of their rows make one and the same forest."""
    rows = spark.range(3000).selectExpr("id % 50 AS a", "id DIV 50 % 9 AS b", "if(id % 50 > 20, 40, 0) + id DIV 50 % 9 * 3 AS y")
    rows = rows.repartition(4, "a", "b").sortWithinPartitions("a", "b")
    features = F.array(F.col("a").cast("double"), F.col("b").cast("double"))
    limits = forest.Limits(max_depth=6, min_instances=3, seed=42)
    whole, parts = (forest.train(rows, "y", features, 5, limits, most_rows=n) for n in (10_000, 300))
    for x, y in zip(whole.trees, parts.trees):
        assert x.node.tolist() == y.node.tolist() and x.feature.tolist() == y.feature.tolist()
        assert x.bin.tolist() == y.bin.tolist() and x.value == pytest.approx(y.value)
    assert parts.importances() == pytest.approx(whole.importances()) and parts.importances().sum() == pytest.approx(1)
    found = rows.select("y", parts.predictor(rows)(features).alias("p")).toPandas()
    assert ((found.y - found.p) ** 2).mean() < 0.02 * found.y.var()


def test_a_tree_splits_where_the_variance_falls_most():
    bins, label = np.array([[0, 0, 1, 1, 2, 2], [0, 1, 0, 1, 0, 1]], np.uint8), np.array([1.0, 1, 1, 1, 7, 9])
    found = forest.grown(1, bins, label, np.ones(6), forest.Limits(max_depth=1, min_instances=2, seed=0))
    assert found["node"].tolist() == [1, 2, 3] and found["feature"].tolist() == [0, -1, -1]
    assert found["bin"][0] == 1 and found["value"].tolist() == pytest.approx([20 / 6, 1, 8]) and found["size"].tolist() == [6, 4, 2]
    flat = forest.grown(1, bins, np.full(6, 0.1), np.ones(6), forest.Limits(max_depth=9, min_instances=1, seed=0))
    assert flat["node"].tolist() == [1]


def joins_of(spark, make):
    """How often `make` and its result read a counting column of the fact, per row."""
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    make(lambda df, c: df.withColumn(c, F.udf(counted, "double").asNondeterministic()(c))).collect()
    return seen.value


def test_checks_and_profile_make_the_fact_once(spark, fact):
    rows = [{"price": float(k), "units_sold": k} for k in range(8)]
    for operator in (Q.iqr_outliers, Q.validation_status, A.column_profile):
        assert joins_of(spark, lambda through: operator(through(fact(rows), "price"))) == 8
    found = {r.column_name: r.n_distinct for r in A.column_profile(fact([*rows, {"price": None, "region": None}])).collect()}
    assert (found["price"], found["region"], found["units_sold"]) == (8, 1, 8)
