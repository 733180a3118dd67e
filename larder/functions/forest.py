"""A regression forest whose cost follows its rows and not its nodes.

MLlib sums up every node of every level over the whole table, and each partition sends a histogram of all features for
each node, however few rows a deep node has. Here only nodes of more than MOST_ROWS rows are split that way:

1. a feature's values become at most 32 bins, at splits found on a bounded sample; neighbouring features share a code of
   at most CELLS values, so that one count by code serves them all;
2. large nodes are split level by level: each task sums counts and labels by tree, node, feature and bin, the sums of a
   node meet in one group, and the driver keeps one split per node;
3. the rows of each smaller node are dealt to a group, and its whole subtree is grown there. Nodes of several trees that
   hold the same part of the feature space share a group, so their rows travel once. Of two siblings only the one with
   fewer rows is counted; the other is what is left of their parent.

Each tree draws its rows with replacement: a row's weight is Poisson(1) by a hash of row, tree and seed, so the same rows
give the same forest on any cluster. Nodes are numbered from the root, 1, the children of i being 2 i and 2 i + 1.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
CELLS = 1024  # of a code
SAMPLE = 10_000  # rows that the bins are found on
MOST_ROWS = 1 << 21  # of a node that is grown in one group
NODES_A_JOB = 4096  # whose sums a task holds at the same time
NODES_AT_ONCE = 256  # of a subtree, whose sums are held at the same time
TREES_A_GROUP = 25
LEAST_GROUPS = 64
ROWS_A_CHUNK = 1 << 17
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
SUMS = "tree int, box int, first long, counts binary, sums binary"
CHUNKS = "part int, group int, first long, row binary, label binary, words binary"
GROWN = "tree int, node binary, feature binary, bin binary, value binary, gains binary"
KINDS = {"node": np.int64, "feature": np.int16, "bin": np.uint8, "value": np.float64, "gain": np.float64, "size": np.float64}
KEPT = ("node", "feature", "bin", "value")


@dataclass(frozen=True)
class Limits:
    max_depth: int
    min_instances: int
    seed: int


def bin_ends(values: np.ndarray) -> np.ndarray:
    """At most 31 splits of a feature: between all its values, or between about equally many rows."""
    distinct, counts = np.unique(values, return_counts=True)
    if len(distinct) > BINS:
        wanted = np.arange(1, BINS) * (len(values) / BINS)
        at = np.unique(np.clip(np.searchsorted(np.cumsum(counts), wanted), 0, len(distinct) - 2))
    else:
        at = np.arange(len(distinct) - 1)
    return (distinct[at] + distinct[at + 1]) / 2


def binned(rows: np.ndarray, ends: list[np.ndarray]) -> np.ndarray:
    """A row per feature with the bin of each row."""
    return np.stack([np.searchsorted(e, x).astype(np.uint8) for e, x in zip(ends, rows.T)])


def draws() -> np.ndarray:
    """The weight that each upper 16 bits of a hash stand for; 255 where the lower ones decide."""
    first = np.arange(1 << 16, dtype=np.uint64) << np.uint64(37)
    low, high = (np.searchsorted(POISSON, x * 2.0**-53, side="right") for x in (first, first + np.uint64((1 << 37) - 1)))
    return np.where(low == high, low, 255).astype(np.uint8)


def weights(rows: np.ndarray, tree: int, seed: int, table: np.ndarray | None = None) -> np.ndarray:
    """How often a tree has drawn each row."""
    start = (tree + 1) * 0xD1342543DE82EF95 + seed * 0xDA942042E4DD58B5 & 0xFFFFFFFFFFFFFFFF
    x = rows.astype(np.uint64)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x += np.uint64(start)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    found = np.take(draws() if table is None else table, (x >> np.uint64(48)).astype(np.uint16))
    unsure = np.flatnonzero(found == 255)
    found[unsure] = np.searchsorted(POISSON, (x[unsure] >> np.uint64(11)) * 2.0**-53, side="right")
    return found


class Codes:
    """Which features share a code, and where a code lies in the words of a row.

    sizes: the bins of each feature. Four codes of 16 bits make a word; a feature with a single bin is in no code.
    """

    def __init__(self, sizes: list[int]):
        self.sizes, self.groups = sizes, []
        for f in sorted(range(len(sizes)), key=lambda f: (-sizes[f], f)):
            if sizes[f] > 1:
                room = (g for g in self.groups if math.prod(sizes[x] for x in g) * sizes[f] <= CELLS)
                if found := next(room, None):
                    found.append(f)
                else:
                    self.groups.append([f])
        self.groups = self.groups or [[0]]
        self.cells = [math.prod(sizes[x] for x in g) for g in self.groups]
        self.words = -(-len(self.groups) // 4)
        self.edges = np.cumsum([0, *sizes])  # of the features in a row of sums
        self.of, self.bin = {}, {}  # the code of a feature, and its bin by code
        for k, g in enumerate(self.groups):
            step = 1
            for f in reversed(g):
                self.of[f], self.bin[f] = k, (np.arange(self.cells[k]) // step % sizes[f]).astype(np.uint8)
                step *= sizes[f]

    def words_of(self, bins: np.ndarray) -> np.ndarray:
        """A row per word, from a row per feature."""
        out = np.zeros((bins.shape[1], 4 * self.words), np.uint16)
        for k, g in enumerate(self.groups):
            for f in g:
                out[:, k] = out[:, k] * np.uint16(self.sizes[f]) + bins[f]
        return np.ascontiguousarray(out.view(np.uint64).T)

    def code(self, words: list[np.ndarray], k: int) -> np.ndarray:
        return words[k // 4].view(np.uint16)[k % 4 :: 4]

    def bins(self, words: list[np.ndarray], f: int) -> np.ndarray:
        return np.take(self.bin[f], self.code(words, self.of[f]))

    def sums(self, words: list[np.ndarray], slot: np.ndarray | None, slots: int, value: np.ndarray) -> np.ndarray:
        """Per slot a row with the sums of `value` by feature and bin; `slot` counts the rows of each slot, one after another."""
        out = np.empty((slots, self.edges[-1]))
        for k, (g, cells) in enumerate(zip(self.groups, self.cells)):
            key = self.code(words, k)
            if slot is not None:
                key = np.repeat(np.arange(0, slots * cells, cells), slot) + key
            found = np.bincount(key, value, slots * cells)
            for f in g:
                x = found.reshape(slots, *[self.sizes[y] for y in g])
                at = g.index(f)
                if len(g) == 2:
                    x = np.ones(x.shape[1]) @ x if at else x @ np.ones(x.shape[2])
                else:
                    x = x.sum(axis=tuple(y + 1 for y in range(len(g)) if y != at))
                out[:, self.edges[f] : self.edges[f + 1]] = x
        for f in range(len(self.sizes)):
            if f not in self.of:  # one bin
                first = self.groups[0][0]
                out[:, self.edges[f]] = out[:, self.edges[first] : self.edges[first + 1]].sum(axis=1)
        return out


def weighted(label: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], float]:
    """What is summed up: counts and labels as one number a row if that is exact, else one after the other.

    One number is weight * (label * scale + 1). It is exact for whole labels while all sums lie below 2**53.
    """
    total = float(weight.sum(dtype=np.float64))
    scale = 2.0 ** int(total).bit_length()
    if (np.rint(label) == label).all() and (float(weight @ np.abs(label)) + 1) * scale < 2.0**52:
        return [weight * (label * scale + 1)], scale
    return [weight.astype(float), weight * label], 0.0


def parted(sums: list[np.ndarray], scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Counts and label sums."""
    if not scale:
        return sums[0], sums[1]
    total = np.floor(sums[0] * (1 / scale))
    return sums[0] - total * scale, total


def best_splits(found: Iterator[tuple], slots: int, min_instances: int) -> dict[str, np.ndarray]:
    """Per slot the split that leaves least variance: feature (-1: none), bin (the last to go left), value, gain, size, and
    count and label sum of the left side. found: per feature counts and label sums by slot and bin."""
    out = {"feature": np.full(slots, -1, np.int16), "bin": np.zeros(slots, np.uint8)}
    out |= {c: np.zeros(slots) for c in ("gain", "left", "left_sum")}
    every = np.arange(slots)
    for f, (counts, sums) in enumerate(found):
        if not f:
            n, s = counts.sum(axis=1), sums.sum(axis=1)
            base = s * s / np.maximum(n, 1)
        if counts.shape[1] < 2:
            continue
        n1, s1 = counts.cumsum(axis=1)[:, :-1], sums.cumsum(axis=1)[:, :-1]
        n2, s2 = n[:, None] - n1, s[:, None] - s1
        score = s1 * s1 / np.maximum(n1, 1) + s2 * s2 / np.maximum(n2, 1) - base[:, None]
        score[(n1 < min_instances) | (n2 < min_instances)] = -np.inf
        at = score.argmax(axis=1)
        gain = score[every, at]
        better = (gain > out["gain"]) & (gain > 1e-12 * base)  # less is rounding
        out["feature"][better], out["bin"][better] = f, at[better]
        out["gain"][better], out["left"][better] = gain[better], n1[every, at][better]
        out["left_sum"][better] = s1[every, at][better]
    return out | {"sum": s, "value": s / np.maximum(n, 1), "size": n}


@dataclass
class Open:
    """Nodes of one level whose rows lie one after another, siblings beside each other, and the sums of their parents."""

    nodes: np.ndarray
    edges: np.ndarray
    words: list[np.ndarray]
    values: list[np.ndarray]
    above: list[np.ndarray] = field(default_factory=list)


def _sums(codes: Codes, now: Open, scale: float) -> list[np.ndarray]:
    sizes, slots = np.diff(now.edges), len(now.nodes)
    if not now.above or not scale:  # differences of rounded sums would not be sums
        return [codes.sums(now.words, sizes, slots, v) for v in now.values]
    fewer = 2 * np.arange(slots // 2) + (sizes[1::2] < sizes[::2])
    counted = np.zeros(slots, bool)
    counted[fewer] = True
    rows = np.flatnonzero(np.repeat(counted, sizes))
    words = [np.take(w, rows) for w in now.words]
    out = []
    for v, whole in zip(now.values, now.above):
        part = codes.sums(words, sizes[fewer], len(fewer), np.take(v, rows))
        both = np.empty((slots, part.shape[1]))
        both[fewer], both[fewer ^ 1] = part, whole - part
        out.append(both)
    return out


def subtree(root: int, codes: Codes, words: list[np.ndarray], label: np.ndarray, weight: np.ndarray, limits: Limits) -> dict[str, np.ndarray]:
    """All nodes of the subtree under `root` over its rows. Parts of a level are finished before their neighbours."""
    parts: dict[str, list] = {c: [] for c in KINDS}

    def write(node, feature, bin, value, gain, size):
        for c, x in zip(KINDS, (node, feature, bin, value, gain, size)):
            parts[c].append(np.asarray(x).astype(KINDS[c]))

    values, scale = weighted(label, weight)
    work = [Open(np.array([root]), np.array([0, len(label)]), words, values)]
    while work:
        now = work.pop()
        sums = _sums(codes, now, scale)
        counts, totals = parted(sums, scale)
        ranges = list(zip(codes.edges, codes.edges[1:]))
        found = best_splits(((counts[:, a:b], totals[:, a:b]) for a, b in ranges), len(now.nodes), limits.min_instances)
        depth = int(now.nodes[0]).bit_length()
        if depth > limits.max_depth:
            found["feature"][:], found["gain"][:], found["bin"][:] = -1, 0, 0
        write(now.nodes, *[found[c] for c in ("feature", "bin", "value", "gain", "size")])
        split = np.flatnonzero(found["feature"] >= 0)
        if not len(split):
            continue
        children = 2 * now.nodes[split][:, None] + [0, 1]
        left, left_sum = found["left"][split], found["left_sum"][split]
        size = np.stack([left, found["size"][split] - left], axis=1)
        total = np.stack([left_sum, found["sum"][split] - left_sum], axis=1)
        further = (size >= 2 * limits.min_instances).any(axis=1) if depth < limits.max_depth else np.zeros(len(split), bool)
        ends = size[~further].ravel()
        none = np.zeros(len(ends))
        write(children[~further].ravel(), none - 1, none, total[~further].ravel() / np.maximum(ends, 1), none, ends)
        for k in range(0, int(further.sum()), NODES_AT_ONCE // 2):
            some = np.flatnonzero(further)[k : k + NODES_AT_ONCE // 2]
            order, edges = [], [0]
            for s in split[some].tolist():
                a, b, f = now.edges[s], now.edges[s + 1], int(found["feature"][s])
                right = codes.bins([w[a:b] for w in now.words], f) > found["bin"][s]
                for side in (~right, right):
                    order.append(np.flatnonzero(side) + a)
                    edges.append(edges[-1] + len(order[-1]))
            rows = np.concatenate(order)
            work.append(Open(children[some].ravel(), np.array(edges), [np.take(w, rows) for w in now.words],
                             [np.take(v, rows) for v in now.values], [x[split[some]] for x in sums]))
    return {c: np.concatenate(x) for c, x in parts.items()}


def grown(root: int, bins: np.ndarray, label: np.ndarray, weight: np.ndarray, limits: Limits) -> dict[str, np.ndarray]:
    """All nodes of the subtree under `root` over rows with these bins, a row per feature."""
    codes = Codes([int(x.max(initial=0)) + 1 for x in bins])
    return subtree(root, codes, list(codes.words_of(bins)), label, weight, limits)


class Tree:
    """Nodes in the order of their numbers, so that siblings are neighbours."""

    def __init__(self, node, feature, bin, value):
        order = np.argsort(node, kind="stable")  # quick where they are in order
        self.node, self.feature, self.bin, self.value = node[order], feature[order], bin[order], value[order]
        self.steps = int(self.node[-1]).bit_length() - 1

    def parts(self) -> tuple:
        """What makes the tree anew on a worker, which may not have this package."""
        return self.node, self.feature, self.bin, self.value

    def ready(self) -> Tree:
        """The tree with what `leaves` needs: a row that is at a leaf stays there."""
        inner = self.feature >= 0
        left = np.where(inner, np.searchsorted(self.node, 2 * self.node), np.arange(len(self.node)))
        self.step = left << 24 | np.where(inner, self.feature, 0).astype(np.int64) << 8 | np.where(inner, self.bin, 255)
        return self

    def leaves(self, flat: np.ndarray, rows: int) -> np.ndarray:
        """The place of each row's last node; flat: the bins of the first row, of the second and so on."""
        at = np.zeros(rows, np.int64)
        first = np.arange(rows) * (len(flat) // max(rows, 1))
        for _ in range(self.steps):
            step = np.take(self.step, at)
            at = (step >> 24) + (np.take(flat, (step >> 8 & 0xFFFF) + first) > (step & 0xFF))
        return at


@dataclass(frozen=True)
class Trees:
    """The whole forest: the ends of the bins and all trees."""

    ends: list
    trees: list
    gains: np.ndarray  # per tree and feature the variance that its splits took away, times rows

    def importances(self) -> np.ndarray:
        """The mean over all trees, one number per feature."""
        shares = self.gains / np.maximum(self.gains.sum(axis=1, keepdims=True), 1e-300)
        return shares.sum(axis=0) / max(shares.sum(), 1e-300)

    def predictor(self, df: DataFrame):
        sent = df.sparkSession.sparkContext.broadcast((self.ends, [t.parts() for t in self.trees]))  # bounded by trees and depth

        @F.pandas_udf("double")
        def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            ends, trees = sent.value[0], [Tree(*p).ready() for p in sent.value[1]]
            for features in batches:
                if not len(features):
                    yield pd.Series([], dtype=float)
                    continue
                flat = binned(np.stack(features.to_numpy()), ends).T.ravel()
                yield pd.Series(sum(t.value[t.leaves(flat, len(features))] for t in trees) / len(trees))

        return predicted.asNondeterministic()  # else a plan that uses a prediction twice may make it twice


class Boxes:
    """Parts of the feature space that nodes stand for: the root's, and what a split leaves of another.

    Nodes with the same bounds have the same box, in whatever tree and by whatever order of splits.
    """

    def __init__(self):
        self.steps: list[tuple[int, int, int, int]] = [(0, 0, 0, 0)]  # the larger box, feature, bin, 1: right side
        self.bounds: list[dict[int, tuple[int, int]]] = [{}]
        self.numbers = {frozenset(): 0}

    def child(self, box: int, feature: int, bin: int, right: int) -> int:
        low, high = self.bounds[box].get(feature, (0, BINS - 1))
        now = self.bounds[box] | {feature: (max(low, bin + 1), high) if right else (low, min(high, bin))}
        key = frozenset(now.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.steps)
            self.steps.append((box, feature, bin, right))
            self.bounds.append(now)
        return self.numbers[key]


class Members:
    """The rows of a block that lie in each box."""

    def __init__(self, codes: Codes, words: list[np.ndarray], steps: list[tuple[int, int, int, int]]):
        self.codes, self.words, self.steps = codes, words, steps
        self.found, self.sides = {0: np.arange(len(words[0]))}, {}

    def of(self, box: int) -> np.ndarray:
        if box not in self.found:
            larger, feature, bin, right = self.steps[box]
            rows, ask = self.of(larger), (larger, feature, bin)
            if ask not in self.sides:
                self.sides[ask] = self.codes.bins([np.take(w, rows) for w in self.words], feature) > bin
            side = self.sides[ask]
            self.found[box] = rows[np.flatnonzero(side if right else ~side)]
        return self.found[box]


def _numbers(column: pa.Array, kind) -> np.ndarray:
    """The values of a column of equally long binaries, one after another."""
    if not len(column):
        return np.array([], kind)
    at = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    at = at[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind)


def _blocks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple]:
    """Rows, labels and words of about ROWS_A_CHUNK rows at a time."""
    held, n = [], 0

    def out():
        row, label = (pa.concat_arrays([b[c] for b in held]).to_numpy() for c in ("row", "label"))
        flat = np.concatenate([_numbers(b["words"], np.uint64) for b in held])
        return row, label, list(np.ascontiguousarray(flat.reshape(-1, words).T))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= ROWS_A_CHUNK:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def _split_large(table: DataFrame, codes: Codes, boxes: Boxes, wanted: list[tuple[int, int]], limits: Limits) -> list:
    """One row per wanted (tree, box): its best split."""
    trees_of: dict[int, list[int]] = {}
    for tree, box in wanted:
        trees_of.setdefault(box, []).append(tree)
    sizes, features = codes.sizes, len(codes.sizes)
    sent = table.sparkSession.sparkContext.broadcast((trees_of, boxes.steps))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (trees_of, steps), codes, table = sent.value, Codes(sizes), draws()
        sums = {box: np.zeros((2, len(of), codes.edges[-1])) for box, of in trees_of.items()}
        first = None
        for row, label, words in _blocks(batches, codes.words):
            first = int(row[0]) if first is None else first
            members = Members(codes, words, steps)
            for box, of in trees_of.items():
                rows = members.of(box)
                own, own_row, own_label = [np.take(w, rows) for w in words], np.take(row, rows), np.take(label, rows)
                for k, tree in enumerate(of if len(rows) else ()):
                    values, scale = weighted(own_label, weights(own_row, tree, limits.seed, table))
                    counts, totals = parted([codes.sums(own, None, 1, v) for v in values], scale)
                    sums[box][0, k] += counts[0]
                    sums[box][1, k] += totals[0]
        for box, of in trees_of.items() if first is not None else ():
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array(of, pa.int32()), "box": pa.array([box] * len(of), pa.int32()), "first": [first] * len(of),
                **{c: [x.tobytes() for x in sums[box][k]] for k, c in enumerate(("counts", "sums"))}})

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first")
        edges = np.cumsum([0, *sizes])
        counts, sums = (sum(np.frombuffer(x) for x in rows[c])[None] for c in ("counts", "sums"))
        found = best_splits(((counts[:, a:b], sums[:, a:b]) for a, b in zip(edges, edges[1:])), 1, limits.min_instances)
        names = ("feature", "bin", "value", "gain", "size", "left")
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], "box": rows["box"].iloc[:1], **{
            c: found[c][:1].astype(int if c in ("feature", "bin") else float) for c in names}})

    return table.mapInArrow(summed, SUMS).groupBy("tree", "box").applyInPandas(
        best, "tree int, box int, feature int, bin int, value double, gain double, size double, left double").collect()


def _groups(small: list[tuple[int, int, int, float]], trees: int, most_rows: int) -> tuple[list, int]:
    """Part, box and (tree, node) pairs of each group, and the number of parts, whose work is about equal.

    small: tree, node, box and about how many rows each node has.
    """
    by_box: dict[int, list] = {}
    for tree, node, box, size in small:
        by_box.setdefault(box, []).append((tree, node, size))
    each = min(max(len(by_box) * trees // LEAST_GROUPS, 4), TREES_A_GROUP)
    groups = []
    for box, nodes in by_box.items():
        count = -(-len(nodes) // each)
        groups += [(box, nodes[len(nodes) * k // count : len(nodes) * (k + 1) // count]) for k in range(count)]
    work = np.array([sum(size for _, _, size in nodes) + 1 for _, nodes in groups], float)
    parts = min(len(groups), max(2 * LEAST_GROUPS, int(work.sum() / most_rows / TREES_A_GROUP)))
    before = np.cumsum(work) - work
    place = np.minimum((before / work.sum() * parts).astype(int), parts - 1).tolist()
    return [(p, box, [(t, n) for t, n, _ in nodes]) for p, (box, nodes) in zip(place, groups)], parts


def _grow_small(table: DataFrame, codes: Codes, boxes: Boxes, small: list[tuple], trees: int, most_rows: int, limits: Limits) -> DataFrame:
    """The subtrees of all small nodes, each grown over its own rows."""
    groups, parts = _groups(small, trees, most_rows)
    sizes = codes.sizes
    sent = table.sparkSession.sparkContext.broadcast((groups, boxes.steps))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (groups, steps), codes, table = sent.value, Codes(sizes), draws()
        for row, label, words in _blocks(batches, codes.words):
            members = Members(codes, words, steps)
            for k, (part, box, nodes) in enumerate(groups):
                rows = members.of(box)
                if len(nodes) == 1:
                    rows = rows[np.flatnonzero(weights(np.take(row, rows), nodes[0][0], limits.seed, table))]
                if len(rows):
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([part], pa.int32()), "group": pa.array([k], pa.int32()), "first": [int(row[rows[0]])],
                        "row": [row[rows].tobytes()], "label": [label[rows].tobytes()], "words": [b"".join(w[rows].tobytes() for w in words)]})

    def subtrees(group: int, chunks: list[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes = Codes(sizes)
        row, label = (np.concatenate([np.frombuffer(c[name][0].as_buffer(), kind) for c in chunks]) for name, kind in (("row", np.int64), ("label", float)))
        blocks = [np.frombuffer(c["words"][0].as_buffer(), np.uint64).reshape(codes.words, -1) for c in chunks]
        words = [np.concatenate([b[k] for b in blocks]) for k in range(codes.words)]
        del blocks, chunks[:]
        for tree, node in sent.value[0][group][2]:
            weight = weights(row, tree, limits.seed, table)
            drawn = np.flatnonzero(weight)
            if not len(drawn):
                continue
            found = subtree(node, codes, [np.take(w, drawn) for w in words], label[drawn], weight[drawn], limits)
            split = found["feature"] >= 0
            gains = np.bincount(found["feature"][split], found["gain"][split], len(sizes))
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([tree], pa.int32()), **{c: [found[c].tobytes()] for c in KEPT}, "gains": [gains.tobytes()]})

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, now, held = draws(), None, []
        for batch in batches:
            for k, group in enumerate(batch["group"].to_pylist()):
                if held and group != now:
                    yield from subtrees(now, held, table)
                now = group
                held.append(batch.slice(k, 1))
        if held:
            yield from subtrees(now, held, table)

    together = table.mapInArrow(dealt, CHUNKS).repartitionById(parts, "part").sortWithinPartitions("group", "first")
    return together.mapInArrow(grow, GROWN)


def train(rows: DataFrame, label: str, features: Column | Sequence[Column], trees: int, limits: Limits, most_rows: int = MOST_ROWS) -> Trees:
    """features: numbers, or an array of numbers. The order of rows within the partitions of `rows` names them, so it must be fixed."""
    if isinstance(features, Column):
        found = rows.select(F.size(features)).first()
        features = [F.get(features, F.lit(k)) for k in range(found[0] if found else 0)]
    columns = [f"x{k}" for k in range(len(features))]
    named = durable(rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(label).cast("double").alias("label"),
        *[x.cast("double").alias(c) for x, c in zip(features, columns)]), "forest_named")
    n = named.count()
    if not n:
        raise ValueError("there are no rows to train a forest on")
    share = int(min(SAMPLE / n, 1.0) * 1_000_000)
    drawn = named.where(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < share).drop("label").collect()
    sample = np.array([r[1:] for r in sorted(drawn)] or [named.first()[2:]], dtype=float)
    ends = [bin_ends(x) for x in sample.T]
    sizes, width = [len(e) + 1 for e in ends], len(ends)
    codes = Codes(sizes)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(sizes)
        for batch in batches:
            values = (batch[f"x{k}"].to_numpy(zero_copy_only=False) for k in range(width))
            bins = np.stack([np.searchsorted(e, x).astype(np.uint8) for e, x in zip(ends, values)])
            words = codes.words_of(bins).T.tobytes()
            each = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * codes.words), batch.num_rows, [None, pa.py_buffer(words)])
            yield pa.RecordBatch.from_arrays([batch["row"], batch["label"], each.cast(pa.binary())], ["row", "label", "words"])

    table = durable(named.mapInArrow(coded, "row long, label double, words binary"), "forest_codes")
    known: list[dict[str, list]] = [{c: [] for c in KEPT} for _ in range(trees)]
    gains, boxes = np.zeros((trees, width)), Boxes()
    small: list[tuple[int, int, int, float]] = []
    open_nodes = [(t, 1, 0, float(n)) for t in range(trees)]
    if n <= most_rows:
        small, open_nodes = open_nodes, []
    while open_nodes:
        following, nodes = [], {(t, box): node for t, node, box, _ in open_nodes}
        for k in range(0, len(open_nodes), NODES_A_JOB):
            wanted = [(t, box) for t, _, box, _ in open_nodes[k : k + NODES_A_JOB]]
            for r in sorted(_split_large(table, codes, boxes, wanted, limits)):
                node = nodes[r.tree, r.box]
                leaf = r.feature < 0 or node.bit_length() > limits.max_depth
                for c, x in zip(KEPT, (node, -1, 0, r.value) if leaf else (node, r.feature, r.bin, r.value)):
                    known[r.tree][c].append(x)
                if leaf:
                    continue
                gains[r.tree, r.feature] += r.gain
                for right, size in enumerate((r.left, r.size - r.left)):
                    child = (r.tree, 2 * node + right, boxes.child(r.box, r.feature, r.bin, right), size)
                    (following if size > most_rows else small).append(child)
        open_nodes = sorted(following)
    if small:
        subtrees = durable(_grow_small(table, codes, boxes, small, trees, most_rows, limits), "forest_subtrees")
        for r in subtrees.toLocalIterator():  # a node has 19 bytes
            for c in KEPT:
                known[r.tree][c].append(np.frombuffer(r[c], KINDS[c]))
            gains[r.tree] += np.frombuffer(r.gains)
    whole = [Tree(*[np.concatenate([np.atleast_1d(np.asarray(x, KINDS[c])) for x in parts[c]]) for c in KEPT]) for parts in known]
    return Trees(ends, whole, gains)
