"""Operators 3, 4 and 5: held-out accuracy, and brute force for what has one right answer."""

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import decision_list, gam, language
from larder.llm.queries import QUERIES

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.01"


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p + k for places in seen.values() if len(places) > 1 for p in places for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered))


def test_word_statistics(spark, make):
    tests = [None, "", " \n ", "a b c\x0bd", "x # $\nx # $\n\n y", " ".join("abcdefgh") + " " + " ".join("abcdefgh"),
             "one two three four five six seven eight nine " * 5, "a " * 40, "é" * 30 + " <|>", "1 2 3 4 5 6 7 8 9"]
    frame = make(list(enumerate(tests)))
    rows = {r.doc_id: r for r in decision_list.word_statistics(frame).collect()}
    for i, text in enumerate(tests):
        assert tuple(rows[i][c] for c in decision_list.STATISTICS) == statistics(text), text


def test_rules_without_labels(odd, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = decision_list.quality_rules(odd, none).collect()
    assert len(rows) == odd.count() and all(r.kept != r.base_failed for r in rows)
    assert decision_list.quality_rules(empty, none).collect() == []


def test_rules_find_a_planted_threshold(spark):
    rows = spark.range(4000).select(
        ((F.col("id") % 100) / 100).alias("x"), (F.col("id") % 7).cast("double").alias("y"),
        (F.xxhash64("id") % 3 == 0).alias("pruning"))
    labelled = rows.withColumn("bad", (F.col("x") > 0.8) & (F.col("y") <= 2))
    rules = decision_list.learn(labelled, ["x", "y"])
    caught = labelled.where(F.lit(False) if not rules else decision_list.all_hold(rules[0]))
    assert caught.where("NOT bad").count() == 0 and caught.where("bad").count() > 0.8 * labelled.where("bad").count()


def test_quality_rules_hold(spark):
    rows = QUERIES["op5_decision_list"](spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    seen = rows.join(labels, "doc_id").where("NOT base_failed")
    assert seen.where("quality = 0 AND kept").count() <= 0.05 * seen.where("quality = 0").count()
    assert seen.where("quality = 1 AND NOT kept").count() <= 0.01 * seen.where("quality = 1").count()


def test_scores(spark, odd, empty):
    rows = QUERIES["op3_gam"](spark, SMALL)
    seen = rows.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("held_out")
    assert seen.where("predicted = quality").count() >= 0.95 * seen.count()
    assert rows.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    labels = spark.createDataFrame([(1, 1), (5, 1), (None, 0)], "doc_id long, quality int")
    assert gam.quality_scores(odd, labels).where("score BETWEEN 0 AND 1").count() == odd.count()
    assert gam.quality_scores(empty, labels).collect() == []


def test_pairs_learn_what_single_measures_cannot():
    pick = np.random.default_rng(0)
    x = pick.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((gam.fit(x, y, gam.Boosting(pairs=0)).score(x) > 0.5) == y).mean() < 0.7
    assert ((gam.fit(x, y).score(x) > 0.5) == y).mean() > 0.95


def plain_probability(word, pieces):
    total = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            p = pieces.get(word[i:j], language.UNKNOWN_PIECE if j - i == 1 else 0.0)
            total[j] += total[i] * p
    return total[-1]


def test_forward_sums_all_segmentations():
    pieces = {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.3, "▁a": 0.2, "ba": 0.1}
    lattice = language.Lattice(list(pieces), np.array(list(pieces.values()))[:, None], 3)
    for word in ("▁a", "▁abab", "▁bzba", "▁" + "ab" * 40):
        assert np.isclose(lattice.forward([word])[0, 0], np.log(plain_probability(word, pieces)))


def test_pieces_of_all_lengths_count():
    pieces = language.pieces_of(PIECES)
    longest = max(pieces, key=len)
    assert len(longest) > 12 and sum(len(p) > 12 for p in pieces) > 200
    some = {p: 0.01 * (k % 7 + 1) for k, p in enumerate(pieces) if p in longest}
    lattice = language.Lattice(list(some), np.array(list(some.values()))[:, None], len(longest))
    assert np.isclose(lattice.forward([longest])[0, 0], np.log(plain_probability(longest, some)))
    without = {p: x for p, x in some.items() if p != longest}
    assert plain_probability(longest, some) > plain_probability(longest, without)


def test_expected_uses_add_up_to_the_word():
    pieces = {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.3, "▁a": 0.2, "ba": 0.1}
    lattice = language.Lattice(list(pieces), np.array(list(pieces.values()))[:, None], 3)
    out = np.zeros(lattice.table.shape)
    lattice.expected(["▁abab"], np.array([[2.0]]), out)
    sizes = np.array([len(p) for p in pieces] + [0, 1])
    assert np.isclose((out[:, 0] * sizes).sum(), 2 * len("▁abab"))


def test_languages(spark, odd, empty):
    rows = QUERIES["op4_language"](spark, SMALL)
    known = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    seen = rows.join(known, "doc_id").where("held_out")
    assert seen.where("lang_pred = lang").count() >= 0.98 * seen.count()
    model = language.learn(odd, PIECES)
    found = {(r.doc_id, r.lang_pred) for r in language.identify(odd, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (1, "en")} <= found
    left = language.reject_unknown(odd, model)
    assert left.columns == odd.columns and left.count() == odd.count() - 4
    assert language.identify(empty, model).collect() == []


def test_a_long_run_of_letters_is_cut_in_parts_that_all_count(make):
    run = "a" * 100_000 + "b"
    parts = language.units(f"1{run.upper()}2c")
    assert "".join(parts) == f"{language.BEGIN}{run}{language.BEGIN}c"
    assert max(map(len, parts)) == language.LONGEST_RUN
    model = language.Model(["x", "y"], ["a", "b"], np.array([[0.5, 0.5], [0.1, 0.4]]), 1)
    assert [(r.lang_pred, round(r.score, 6)) for r in language.identify(make([(1, run)]), model).collect()] == [("y", 0.8)]


def test_a_full_memory_changes_no_score():
    model = language.Model(["x", "y"], ["a", "b", "ab"], np.array([[0.5, 0.2], [0.3, 0.4], [0.2, 0.4]]), 2)
    slices = [pa.array(t, pa.string()) for t in (["ab a", None, "7 !"], [], ["", "ba-ab ab", "a" * 99], ["ab a", "b7a"])]
    whole, small = language._Scorer(model), language._Scorer(model, most_characters=20)
    for texts in slices:
        lang, score = whole.score(texts)
        assert (lang, score) == small.score(texts)
    assert len(small.place) < len(whole.place)


def test_a_rare_language_is_learned(spark):
    rows = [(i, "the house stands by the river and the people walk there", "en") for i in range(4000)]
    rows += [(5000 + i, "das Haus steht am Fluss und die Leute gehen dort", "de") for i in range(4000)]
    rows += [(10_000 + i, "la casa queda cerca del agua donde camina gente", "es") for i in range(3)] + [(20_000, "7", "xx")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(frame, PIECES, training=language.Training(most_documents=40))
    assert model.languages == ["de", "en", "es"]
    found = language.identify(frame.where("doc_id < 20000"), model).join(frame, "doc_id")
    assert found.where("lang_pred <> lang").count() == 0


def test_shares_are_bounded_by_language():
    assert language.shares({"a": 10, "b": 1000, "c": 3000}, 500) == {"a": 1.0, "b": 0.245, "c": 245 / 3000}
    assert language.shares({"a": 10, "b": 20}, 30) == {"a": 1.0, "b": 1.0}
    assert language.shares({}, 30) == {}


def test_nothing_to_learn_from(odd, empty):
    model = language.learn(empty, PIECES)
    assert {r.lang_pred for r in language.identify(odd, model).collect()} == {"und"}


def test_without_a_language_texts_with_letters_stay(odd, empty):
    left = language.reject_unknown(odd, language.learn(empty, PIECES))
    known = language.reject_unknown(odd, language.learn(odd, PIECES))
    assert left.columns == odd.columns
    assert sorted(map(str, left.collect())) == sorted(map(str, known.collect())) and left.count() == odd.count() - 4


@pytest.mark.parametrize("name", ["op3_gam", "op4_language"])
def test_label_columns_are_no_inputs(spark, name):
    assert set(QUERIES[name](spark, SMALL).columns) <= {"doc_id", "held_out", "score", "predicted", "lang_pred"}
