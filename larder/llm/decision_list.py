"""Quality rules: word statistics and a learned decision list (operator 5), in DataFrame functions only.

`word_statistics` computes, row by row and without a shuffle, the sizes and repetitions of a text.
`learn` covers the low-quality rows of a labelled table rule by rule (sequential covering). A rule is
a conjunction of thresholds. It grows by the condition with the best information gain on the growing
rows, is cut back to the prefix that does best on the pruning rows, and is kept while it is precise
enough there. Every step is one aggregate over the rows that no earlier rule covers: counts by
feature, threshold cell and label, whatever the number of rows. `verdict` turns the ordered rules
into one conditional expression.

Repeated 8-word windows are compared by 64-bit hashes of their words (for a text of a million words
the chance of any wrong match is about 3e-8); hashing keeps the row at 8 bytes a window.

Defined cases: a null text has no words, so base_failed is true; a null id is kept and has no label;
rows that repeat an id are separate rows; labels other than 0 and 1 are not learned from; without
labels of both kinds there are no rules and only base_failed decides; other columns are ignored;
an empty table gives no rows. A very long text is one row, its words an array in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import durable

WINDOW = 8
SPACE = "[\\x20\\x09-\\x0D]+"
WHITE_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("mean_word_chars", "symbols_a_word", "dup_lines_a_line", "repeat_share", "distinct_share",
            "capital_share", "digit_share", "stops_a_word", "exclamations_a_word", "words")


def _count_of(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")


def word_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the five statistics (long) and the counts that the features need."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    cut = rows.select(
        "doc_id",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda s: F.translate(s, WHITE_SPACE, "") != "").alias("lines"),
        F.char_length(F.translate("text", WHITE_SPACE, "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        _count_of(F.col("text"), "0123456789").alias("n_digits"),
        _count_of(F.col("text"), "".join(map(chr, range(65, 91)))).alias("n_capitals"),
        _count_of(F.col("text"), ".?").alias("n_stops"),
        _count_of(F.col("text"), "!").alias("n_exclamations"),
    )
    windows = F.size("words") - WINDOW  # the last window's number
    hashes = F.transform(F.sequence(F.lit(0), windows),
                         lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))
    counted = cut.select(
        "doc_id", "word_chars", "n_symbols", "n_digits", "n_capitals", "n_stops", "n_exclamations",
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(windows >= 1, hashes).alias("hashes"),
    )
    # Only a text with equal hashes is sorted: by hash, then place. Equal neighbours are repeated windows.
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = counted.withColumn("placed", F.when(repeats, F.sort_array(
        F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("hashes")

    def repeated(x: Column, k: Column) -> Column:
        before, after = F.get("placed", k - 1), F.get("placed", k + 1)
        return F.coalesce(before["h"] == x["h"], F.lit(False)) | F.coalesce(after["h"] == x["h"], F.lit(False))

    places = placed.withColumn("places", F.sort_array(
        F.transform(F.filter("placed", repeated), lambda x: x["i"]))).drop("placed")
    covered = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return places.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("places")


def with_features(statistics: DataFrame) -> DataFrame:
    """The statistics as ratios that do not depend on the length of a text."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return statistics.withColumns({
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_a_word": F.col("n_symbols") / words,
        "dup_lines_a_line": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct") / words,
        "capital_share": F.col("n_capitals") / chars,
        "digit_share": F.col("n_digits") / chars,
        "stops_a_word": F.col("n_stops") / words,
        "exclamations_a_word": F.col("n_exclamations") / words,
        "words": F.col("n_words").cast("double"),
    })


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > threshold, else feature <= threshold
    threshold: float

    def holds(self) -> Column:
        value = F.col(self.feature)
        return (value > self.threshold) if self.above else (value <= self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class Learning:
    cells: int = 24  # thresholds tried for each feature
    most_rules: int = 6
    most_conditions: int = 3
    least_precision: float = 0.9  # on the pruning rows
    least_rows: int = 5  # low-quality growing rows that a rule covers


def all_hold(rule: Rule) -> Column:
    found = F.lit(True)
    for condition in rule:
        found = found & condition.holds()
    return found


def _thresholds(rows: DataFrame, features: Sequence[str], cells: int) -> dict[str, list[float]]:
    """Distinct quantiles of each feature; for the low-quality rows too, as those may be few."""
    points = [k / cells for k in range(1, cells)]
    low = [F.percentile_approx(F.when(F.col("bad"), F.col(f)), points).alias(f"low_{f}") for f in features]
    row = rows.agg(*[F.percentile_approx(f, points).alias(f) for f in features], *low).first()
    return {f: sorted({float(x) for x in [*(row[f] or []), *(row[f"low_{f}"] or [])]}) for f in features}


def _cell(feature: str, steps: Sequence[float]) -> Column:
    """The number of thresholds below a value."""
    return F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: F.col(feature) > t))


def _cell_counts(rows: DataFrame, thresholds: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """By feature: rows in each cell between thresholds, as (bad, good). One aggregate for all features."""
    cells = [F.struct(F.lit(f).alias("feature"), _cell(f, steps).alias("cell")) for f, steps in thresholds.items() if steps]
    counts = {f: [[0, 0] for _ in range(len(steps) + 1)] for f, steps in thresholds.items()}
    if not cells:
        return counts
    long = rows.select("bad", F.inline(F.array(*cells)))
    found = long.groupBy("feature", "cell").agg(F.count_if("bad").alias("bad"), F.count("*").alias("n")).collect()
    for r in found:  # one row for each cell of each feature
        counts[r["feature"]][r["cell"]] = [r["bad"], r["n"] - r["bad"]]
    return counts


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """Information gain of a condition about its low-quality rows."""
    if not bad:
        return 0.0
    share = math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before))
    return bad * share


def _best_condition(counts: dict[str, list[list[int]]], thresholds: dict[str, list[float]], least: int) -> tuple:
    best = (0.0, None, 0, 0)
    for feature, cells in counts.items():
        all_bad, all_good = (sum(c[i] for c in cells) for i in (0, 1))
        below_bad = below_good = 0
        for threshold, (bad, good) in zip(thresholds[feature], cells):
            below_bad, below_good = below_bad + bad, below_good + good
            for above, b, g in ((False, below_bad, below_good), (True, all_bad - below_bad, all_good - below_good)):
                gain = _gain(b, g, all_bad, all_good) if b >= least else 0.0
                if gain > best[0] + 1e-9:
                    best = (gain, Condition(feature, above, threshold), b, g)
    return best


def learn(labelled: DataFrame, features: Sequence[str] = FEATURES, learning: Learning = Learning()) -> list[Rule]:
    """Ordered rules that find low quality; labelled has the features, `bad` and `pruning` (booleans)."""
    thresholds = _thresholds(labelled, features, learning.cells)
    rules: list[Rule] = []
    left = labelled
    while len(rules) < learning.most_rules:
        growing = left.where(~F.col("pruning"))
        rule: Rule = ()
        while len(rule) < learning.most_conditions:
            counts = _cell_counts(growing.where(all_hold(rule)), thresholds)
            _, condition, _, good = _best_condition(counts, thresholds, learning.least_rows)
            if condition is None:
                break
            rule = (*rule, condition)
            if not good:
                break
        if not rule:
            break
        prefixes = [rule[: k + 1] for k in range(len(rule))]
        row = left.where("pruning").agg(*[
            x for k, p in enumerate(prefixes)
            for x in (F.count_if(all_hold(p) & F.col("bad")).alias(f"b{k}"), F.count_if(all_hold(p)).alias(f"n{k}"))]).first()
        worth = [((2 * row[f"b{k}"] - row[f"n{k}"]) / max(row[f"n{k}"], 1), -k) for k in range(len(prefixes))]
        k = -max(worth)[1]
        if not row[f"n{k}"] or row[f"b{k}"] < learning.least_precision * row[f"n{k}"]:
            break
        found = _centred(prefixes[k], left)
        rules.append(found)
        left = left.where(~all_hold(found))
    return rules


def _centred(rule: Rule, rows: DataFrame) -> Rule:
    """Thresholds moved to the middle of the gap between the values next to them, which changes no row's side."""
    row = rows.agg(*[x for k, c in enumerate(rule) for x in (
        F.max(F.when(F.col(c.feature) <= c.threshold, F.col(c.feature))).alias(f"low{k}"),
        F.min(F.when(F.col(c.feature) > c.threshold, F.col(c.feature))).alias(f"high{k}"))]).first()
    return tuple(
        c if row[f"low{k}"] is None or row[f"high{k}"] is None
        else Condition(c.feature, c.above, (row[f"low{k}"] + row[f"high{k}"]) / 2)
        for k, c in enumerate(rule))


def verdict(rules: Sequence[Rule]) -> Column:
    """The text of the first rule that holds, or null: an ordered conditional expression."""
    found = F.when(base_failed(), "base")
    for rule in rules:
        found = found.when(all_hold(rule), " and ".join(map(str, rule)))
    return found


def quality_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", learning: Learning = Learning()) -> DataFrame:
    """Statistics of every row, base_failed, kept, and the rule that decided.

    The statistics are computed once and written to the shared folder: numbers only, no texts.
    """
    rows = durable(with_features(word_statistics(df, id_col, text_col)), "statistics")
    known = labels.where(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) == 0).alias("bad"))
    pruning = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    labelled = durable(rows.where(~base_failed()).join(known, "doc_id").select(
        *FEATURES, "bad", pruning.alias("pruning")), "labelled")
    rules = learn(labelled, FEATURES, learning)
    return rows.withColumn("rule", verdict(rules)).select(
        "doc_id", *STATISTICS, base_failed().alias("base_failed"), F.col("rule").isNull().alias("kept"), "rule")
