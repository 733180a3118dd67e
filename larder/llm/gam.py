"""Quality scores by a generalised additive model with pairwise interactions (operator 3).

Each text gets a dozen measures that depend on its characters, words and lines alone. Measures are
cut into bins. Boosting goes round the measures; each step fits a shallow tree over one measure's
bins to the current gradients and adds it to that measure's lookup table. Then the pairs with the
best remaining gain get tables of their own, by the same rounds. A score is the logistic function
of a sum of table entries, so scoring is a few array lookups for each row.

The tables are fitted where the session runs, on a bounded sample of labelled rows (`most_rows`, by a
hash of the id). Measures and scores cover all texts; measures are computed once and written to the
shared folder (a few numbers for each document).

Defined cases: a null text is measured as empty; null and repeated ids stay rows and are not learned
from if null; labels other than 0 and 1 are ignored; with labels of one kind only, or none, every
score is the label's (smoothed) share or one half; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.encoding import offsets_of, slices
from larder.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEASURES = ("log_words", "mean_word_bytes", "capitals", "digits", "symbols", "exclamations", "stops", "commas",
            "high_bytes", "distinct_words", "distinct_pairs", "distinct_lines", "lines_a_word", "short_words")
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>@\\^_~={}[]", "!", ".?", ",;:")


def _class_of_byte() -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    for k, characters in enumerate(CLASSES, 1):
        table[list(characters.encode())] = k
    table[128:] = len(CLASSES) + 1
    return table


def _distinct(owner: np.ndarray, codes: np.ndarray, size: int, texts: int) -> np.ndarray:
    """Different codes by owner; codes are below size."""
    return np.bincount(np.unique(owner * size + codes) // max(size, 1), minlength=texts)


def measures(texts: pa.Array, class_of_byte: np.ndarray) -> np.ndarray:
    """One row per text, one column per measure; shares of an empty text are 0."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    n = len(texts)
    sizes = offsets_of(pc.binary_length(texts).to_numpy())
    first = int(np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + 1)[-1])
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[first : first + sizes[-1]] if sizes[-1] else np.zeros(0, np.uint8)
    kinds = class_of_byte[data]
    counts = np.zeros((n, len(CLASSES) + 2))
    for k in range(1, counts.shape[1]):
        places = np.flatnonzero(kinds == k)
        counts[:, k] = np.diff(np.searchsorted(places, sizes))
    words = pc.ascii_split_whitespace(texts)
    flat, owner = words.flatten(), np.repeat(np.arange(n), np.diff(words.offsets.to_numpy()))
    real = pc.binary_length(flat).to_numpy() > 0
    coded = flat.dictionary_encode()
    codes, owner, size = coded.indices.to_numpy()[real].astype(np.int64), owner[real], len(coded.dictionary)
    lengths = pc.binary_length(flat).to_numpy()[real]
    n_words = np.bincount(owner, minlength=n)
    same = owner[:-1] == owner[1:]
    pair_names, pairs = np.unique(codes[:-1][same] * max(size, 1) + codes[1:][same], return_inverse=True)
    lines = pc.split_pattern(texts, "\n")
    lined = lines.flatten().dictionary_encode()
    n_lines = np.diff(lines.offsets.to_numpy())
    line_owner = np.repeat(np.arange(n), n_lines)
    w, chars = np.maximum(n_words, 1), np.maximum(np.diff(sizes), 1)
    columns = [
        np.log1p(n_words), np.bincount(owner, lengths, n) / w, counts[:, 1] / chars, counts[:, 2] / chars,
        counts[:, 3] / w, counts[:, 4] / w, counts[:, 5] / w, counts[:, 6] / w, counts[:, 7] / chars,
        _distinct(owner, codes, size, n) / w,
        _distinct(owner[:-1][same], pairs, len(pair_names), n) / np.maximum(n_words - 1, 1),
        _distinct(line_owner, lined.indices.to_numpy().astype(np.int64), len(lined.dictionary), n) / np.maximum(n_lines, 1),
        n_lines / w, np.bincount(owner, lengths <= 2, n) / w,
    ]
    return np.stack(columns, axis=1).astype(float)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measures of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _class_of_byte()
        for batch in batches:
            for a, b in slices(batch["text"], 4 << 20):
                found = measures(batch["text"][a:b], table)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][a:b], *[pa.array(c) for c in found.T]], ["doc_id", *MEASURES])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{m} double" for m in MEASURES))


@dataclass(frozen=True)
class Boosting:
    most_rows: int = 40_000
    bins: int = 48
    coarse: int = 8  # bins of a measure in a pair
    rounds: int = 120
    pair_rounds: int = 40
    pairs: int = 4
    leaves: int = 3
    rate: float = 0.15
    penalty: float = 2.0  # added to a leaf's second derivatives
    least_weight: float = 1.0


@dataclass
class Gam:
    """intercept, one table for each measure, and tables for pairs of measures."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # i, j, edges, edges, table

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, k])]
        for i, j, left, right, table in self.pairs:
            total += table[np.searchsorted(left, x[:, i]), np.searchsorted(right, x[:, j])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def edges_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Edges midway between neighbouring values, near equal shares of the rows."""
    values, counts = np.unique(x, return_counts=True)
    if len(values) < 2:
        return np.zeros(0)
    share = np.cumsum(counts)[:-1] / len(x)
    cell = np.floor(share * bins)
    at = np.flatnonzero(np.diff(cell, prepend=-1) > 0)
    return np.unique((values[at] + values[at + 1]) / 2)


def _leaf(g: np.ndarray, h: np.ndarray, b: Boosting) -> tuple[float, float]:
    total, weight = g.sum(), h.sum() + b.penalty
    return total / weight, total * total / weight


def shallow_tree(g: np.ndarray, h: np.ndarray, b: Boosting) -> np.ndarray:
    """Values by bin: the best splits into a few runs of bins, one after the other."""
    runs = [(0, len(g))]
    while len(runs) < b.leaves:
        best = (1e-9, None)
        for r, (s, e) in enumerate(runs):
            if e - s < 2:
                continue
            cg, ch = np.cumsum(g[s:e]), np.cumsum(h[s:e])
            lg, lh, rg, rh = cg[:-1], ch[:-1], cg[-1] - cg[:-1], ch[-1] - ch[:-1]
            gain = lg**2 / (lh + b.penalty) + rg**2 / (rh + b.penalty) - cg[-1] ** 2 / (ch[-1] + b.penalty)
            gain[(lh < b.least_weight) | (rh < b.least_weight)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (r, s + k + 1))
        if best[1] is None:
            break
        r, cut = best[1]
        s, e = runs[r]
        runs[r : r + 1] = [(s, cut), (cut, e)]
    out = np.zeros(len(g))
    for s, e in runs:
        out[s:e] = _leaf(g[s:e], h[s:e], b)[0]
    return out


def quadrants(g: np.ndarray, h: np.ndarray, b: Boosting) -> tuple[np.ndarray, float]:
    """Values of a pair's cells: the best cut of either side into two, and its gain."""
    cg, ch = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))
    best = (0.0, 0, 0)
    whole = cg[-1, -1] ** 2 / (ch[-1, -1] + b.penalty)

    def parts(i, j):
        for a, z in ((0, i), (i, g.shape[0])):
            for c, y in ((0, j), (j, g.shape[1])):
                yield a, z, c, y, *(m[z, y] - m[a, y] - m[z, c] + m[a, c] for m in (cg, ch))

    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            gain = sum(x * x / (w + b.penalty) for *_, x, w in parts(i, j)) - whole
            if gain > best[0]:
                best = (gain, i, j)
    out = np.zeros(g.shape)
    if best[0] > 0:
        for a, z, c, y, x, w in parts(*best[1:]):
            out[a:z, c:y] = x / (w + b.penalty)
    return out, best[0]


def fit(x: np.ndarray, y: np.ndarray, b: Boosting = Boosting()) -> Gam:
    """Cyclic boosting on rows of measures x with labels y of 0 and 1."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = Gam(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [edges_of(x[:, k], b.bins) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, x[:, k]) for k, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(b.rounds):
        for table, at in zip(model.tables, binned):
            g, h = (np.bincount(at, m, len(table)) for m in slopes())
            step = b.rate * shallow_tree(g, h, b)
            table += step
            total += step[at]
    coarse = [edges_of(x[:, k], b.coarse) for k in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, k]) for k, e in enumerate(coarse)]

    def grid(i, j):
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at = cells[i] * shape[1] + cells[j]
        return at, [np.bincount(at, m, shape[0] * shape[1]).reshape(shape) for m in slopes()]

    gains = [(quadrants(*grid(i, j)[1], b)[1], i, j) for i, j in combinations(range(x.shape[1]), 2)]
    for _, i, j in sorted(gains, key=lambda z: (-z[0], z[1:]))[: b.pairs]:
        model.pairs.append((i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))))
    for _ in range(b.pair_rounds):
        for i, j, _, _, table in model.pairs:
            at, (g, h) = grid(i, j)
            step = b.rate * quadrants(g, h, b)[0]
            table += step
            total += step.ravel()[at]
    return model


def held_out(id_col: str = "doc_id", every: int = 3) -> Column:
    """The rows that are never learned from: crc32 of the id as text, modulo `every`, is 1. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 1, F.lit(True))


def learn(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
          boosting: Boosting = Boosting()) -> Gam:
    """labels: the labelled rows to learn from; a bounded sample of them meets the measures."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    share = min(1.0, boosting.most_rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = measured.join(chosen, "doc_id").select("doc_id", *MEASURES, "label").toPandas()  # about most_rows
    rows = rows.sort_values(["doc_id", *MEASURES, "label"])
    return fit(rows[list(MEASURES)].to_numpy(float), rows["label"].to_numpy(float), boosting)


def score(measured: DataFrame, model: Gam) -> DataFrame:
    """doc_id, score, predicted."""
    tables = (model.intercept, model.edges, model.tables, model.pairs)
    sent = measured.sparkSession.sparkContext.broadcast(tables)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Gam(*sent.value)
        for batch in batches:
            found = model.score(np.stack([batch[m].to_numpy() for m in MEASURES], axis=1))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found)], ["doc_id", "score"])

    scored = measured.mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", boosting: Boosting = Boosting()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; held-out rows are not learned from."""
    measured = durable(measure(df, id_col, text_col), "measures")
    model = learn(measured, labels.where(~held_out(id_col)), id_col, label_col, boosting)
    return score(measured, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
