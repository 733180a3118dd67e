"""The forest on large tables: rows travel and are counted once for many trees, and are written once before training."""

import random
import subprocess
import sys
from dataclasses import replace

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from larder.functions import forest
from larder.operators import forecast as FC
from larder.operators import models as M
from larder.params import DEFAULTS
from tests.conftest import day


def test_nodes_with_equal_bounds_share_a_group():
    boxes = forest.Boxes()
    one = boxes.child(boxes.child(0, 2, 9, 0), 5, 3, 1)
    other = boxes.child(boxes.child(boxes.child(0, 5, 3, 1), 2, 20, 0), 2, 9, 0)
    assert one == other and boxes.child(0, 2, 9, 1) != boxes.child(0, 2, 9, 0)
    groups, parts = forest._groups([(t, 4, one, 1000.0) for t in range(100)], 100, 10_000)
    assert sum(len(nodes) for _, _, nodes in groups) == 100 and {box for _, box, _ in groups} == {one}
    assert len(groups) <= 25  # so often a row travels; it did once for each tree that drew it
    assert {p for p, _, _ in groups} == set(range(parts))


def test_of_two_siblings_one_is_counted(monkeypatch):
    rng, counted, plain = np.random.default_rng(0), [], forest.Codes.sums
    bins = rng.integers(0, 32, (3, 4000)).astype(np.uint8)
    label = bins[0] * 3.0 + (bins[1] > 11) * 20 + rng.integers(0, 9, 4000)

    def sums(self, words, slot, slots, value):
        counted.append(len(value))
        return plain(self, words, slot, slots, value)

    monkeypatch.setattr(forest.Codes, "sums", sums)
    limits = forest.Limits(max_depth=8, min_instances=3, seed=0)
    whole = forest.grown(1, bins, label, np.ones(4000), limits)
    assert counted[0] == 4000 and sum(counted[1:]) <= 7 * 2000
    halves = forest.grown(1, bins, label + 0.5, np.ones(4000), limits)  # counted without differences
    assert sum(counted) > 30_000
    for c, added in (("node", 0), ("feature", 0), ("bin", 0), ("value", 0.5), ("size", 0)):
        x, y = (found[c][np.argsort(found["node"])] for found in (whole, halves))
        assert y == pytest.approx(x + added)


def test_sums_in_one_number_are_exact_or_not_taken():
    weight = np.array([3, 0, 1], np.uint8)
    for label in ([5.0, 7.0, -9.0], [0.5, 1.0, 2.0], [3e15, 1.0, 1.0]):
        values, scale = forest.weighted(np.array(label), weight)
        assert bool(scale) == (label[1] == 7)
        counts, sums = forest.parted([np.array([v.sum()]) for v in values], scale)
        assert counts[0] == 4 and sums[0] == 3 * label[0] + label[2]


def test_draws_are_those_of_the_whole_hash():
    rows, mask = [0, 1, 5, 2**33 + 7, *random.Random(1).sample(range(2**40), 3000)], 2**64 - 1
    for tree in (0, 99):
        found = forest.weights(np.array(rows), tree, 42)
        for row, weight in zip(rows, found.tolist()):
            x = (row * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1342543DE82EF95 + 42 * 0xDA942042E4DD58B5) & mask
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
            x ^= x >> 31
            assert weight == np.searchsorted(forest.POISSON, (x >> 11) * 2.0**-53, side="right")


def test_a_word_holds_the_bins_of_all_features():
    rng, sizes = np.random.default_rng(0), [32, 7, 1, 32, 12, 2, 31, 2, 32, 32, 32, 32]
    bins = np.stack([rng.integers(0, s, 500) for s in sizes]).astype(np.uint8)
    codes = forest.Codes(sizes)
    words = list(codes.words_of(bins))
    assert all((codes.bins(words, f) == bins[f]).all() for f in codes.of) and 2 not in codes.of
    value = rng.integers(0, 99, 500).astype(float)
    found = codes.sums(words, np.array([200, 0, 300]), 3, value)
    for f, (a, b) in enumerate(zip(codes.edges, codes.edges[1:])):
        for slot, rows in enumerate((slice(0, 200), slice(0, 0), slice(200, 500))):
            assert found[slot, a:b].tolist() == np.bincount(bins[f, rows], value[rows], sizes[f]).tolist()


def test_leaves_are_found_by_following_the_splits():
    rng = np.random.default_rng(0)
    bins = rng.integers(0, 32, (4, 3000)).astype(np.uint8)
    label = bins[0] * 2.0 + (bins[2] > 5) * 30 + rng.integers(0, 20, 3000)
    found = forest.grown(1, bins, label, np.ones(3000), forest.Limits(max_depth=9, min_instances=2, seed=0))
    tree = forest.Tree(*[found[c] for c in forest.KEPT])
    place = {n: k for k, n in enumerate(tree.node.tolist())}
    at = tree.ready().leaves(bins.T.ravel(), 3000)
    for row in range(0, 3000, 100):
        node = 1
        while tree.feature[place[node]] >= 0:
            node = 2 * node + int(bins[tree.feature[place[node]], row] > tree.bin[place[node]])
        assert tree.node[at[row]] == node


def test_rows_are_written_once_before_training(spark, fact, monkeypatch):
    written = []
    for module in (FC, M, forest):
        monkeypatch.setattr(module, "durable", lambda df, name="durable", plain=module.durable: (written.append(name), plain(df, name))[1])
    rows = [dict(date=day(i), store_id=f"S{s}", units_sold=10 + i % 7 + 5 * s, weather="ABC"[i % 3]) for i in range(60) for s in range(3)]
    fit = M.random_forest_forecast(fact(rows), replace(DEFAULTS, trees=3, max_depth=4))
    assert written == ["store_days", "store_ranges", "forest_named", "forest_codes", "forest_subtrees"]
    names = [r.feature for r in fit.importance(100).collect()]
    assert len(names) == 22 and {"store_level", "weather_is_A", "weather_is___unknown"} <= set(names)
    other = fit.model.transform(fit.features.withColumn("weather", F.lit("Z"))).where("prediction IS NULL")
    assert fit.predictions().count() > 0 and other.count() == 0


def test_a_prediction_that_is_used_twice_is_made_once(spark):
    """Steps that feed predictions back would double their work with each step."""
    ends, one = [np.array([2.5]), np.array([0.5])], np.array
    tree = forest.Tree(one([1, 2, 3]), one([0, -1, -1], np.int16), one([0, 0, 0], np.uint8), one([0.0, 1.0, 4.0]))
    model = M.Forest(M.Inputs(("a", "b"), {}), forest.Trees(ends, [tree], np.ones((1, 2))))
    state = spark.createDataFrame([([1.0, 2.0],), ([5.0, 5.0],)], "recent array<double>")
    for _ in range(4):
        scored = model.transform(state.withColumns({"a": F.element_at("recent", -1), "b": F.element_at("recent", -2)}))
        state = scored.select(F.concat(F.slice("recent", 2, 1), F.array("prediction")).alias("recent"))
    assert state._jdf.queryExecution().optimizedPlan().toString().count("predicted(") == 4
    assert sorted(r.recent for r in state.collect()) == [[1.0, 1.0], [4.0, 4.0]]


def test_texts_become_one_number_for_each_label(spark):
    inputs = M.Inputs(("n",), {"t": ("a", "b")})
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "n int, t string")
    found = rows.select([c.alias(k) for k, c in inputs.columns().items()]).orderBy("n").collect()
    assert [tuple(r) for r in found] == [(1, 1, 0, 0), (2, 0, 1, 0), (3, 0, 0, 1), (4, 0, 0, 1)]
    assert rows.select([c for c in M.Inputs((), {"t": ()}).columns().values()]).distinct().collect() == [(1.0,)]


@pytest.mark.parametrize("shift", [0, 1, 3])
def test_rolling_means_by_differences(spark, shift):
    values = [None if i % 11 == 3 else i * i % 17 for i in range(80)]
    whole = spark.createDataFrame([(s, day(i), v) for s in ("A", "B") for i, v in enumerate(values[ord(s) - 65:])], "store_id string, date date, units_sold long")
    by_window = FC.rolling_features(whole.withColumn("units_sold", F.col("units_sold").cast("double")), shift=shift)
    found, wanted = (df.orderBy("store_id", "date").select("rolling_7", "rolling_14", "rolling_28").collect()
                     for df in (FC.rolling_features(whole, shift=shift), by_window))
    assert found == wanted and any(r.rolling_7 is not None for r in found)


def test_the_forest_travels_without_the_package():
    for sent in (forest.subtree, forest.Members, forest.Codes([3, 2]), forest.Tree, forest.best_splits, forest.draws):
        code = "import pickle, sys; pickle.load(sys.stdin.buffer); print([m for m in sys.modules if m.startswith('larder')])"
        done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(sent), capture_output=True, cwd="/")
        assert done.stdout.decode().strip() == "[]", done.stderr.decode()
