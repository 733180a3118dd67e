"""Trie of conversation prefixes from ternary search trees by range shard (operator 13).

A conversation is a sequence of turns (role, text); conversations that begin alike share nodes. A
turn is known by the first 128 bits of its SHA-256, so texts never move. Then

1. `rebuilt` puts each conversation together as one path of turn keys, in one shuffle;
2. the paths are range-partitioned by (path, conv_id), which also splits any number of equal paths.
   A task takes its range in blocks (shards). The turn keys of a shard are dictionary-encoded by
   rank, its distinct paths go into a ternary search tree with the median first, so that the
   lower and upper links of a level stay balanced, and a traversal with an explicit stack
   accumulates members, children, leaves and saved bytes from the end upwards;
3. only nodes on the first and the last path of a shard can go on in its neighbours. They carry a
   digest of their path and are merged by it. The sums of two shards add up once each node is counted
   by the first shard that has it (children, bytes kept once) and each leaf by the last. How
   deep two neighbouring shards agree says by how much a shard's sums are too high, so the
   correction is a join of a few numbers per shard, and no task sees more than its own range.

Defined cases: null role and text are empty; turns come in the order of `turn` (null first), equal turns
by key; repeated rows are repeated turns; rows without a conv_id belong to no conversation and are
left out; conversations without turns are members of the root; an empty table has no nodes; other
columns are ignored. One conversation is one path and lies in one task, as long as it may be. SHA-256
of the ids that end at a node has to run over them in order: it streams, in memory for one batch.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = 32  # hexadecimal digits of a turn key
FAMILY = 5  # conversations c - c % 5 to c lend their first turns
MOST_LENT = 8  # crc32 % 9 is 8 at most
BLOCK_TURNS = 200_000  # of a shard, more only if one path has more
PIECE = 256  # ids in a row of a boundary node's ends

NODES = ("shard long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "total_bytes long, once_bytes long, ends_sha256 string, node string, parent_node string, "
         "first_sum long, own_bytes long, is_last boolean, piece long, ids string")
NAMES = [c.split()[0] for c in NODES.split(", ")]


def family(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def lent(conv_id: Column) -> Column:
    """How many turns of its family's first conversation one begins with."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, key, bytes of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(" "), role, text)
    return df.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.substring(F.sha2(whole, 256), 1, KEY).alias("key"), F.octet_length(text).cast("long").alias("bytes"))


def rebuilt(df: DataFrame) -> DataFrame:
    """conv_id, path (turn keys, one after the other), bytes (of each turn) of every conversation."""
    placed = turns(df).withColumn("family", family(F.col("conv_id"))).repartition("family")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "key", "bytes")
    convs = placed.groupBy("family", "conv_id").agg(F.sort_array(F.collect_list(order)).alias("turns"))
    firsts = convs.where(F.col("conv_id") == F.col("family")).select(
        "family", F.slice("turns", 1, MOST_LENT).alias("lent_turns"))
    n = lent(F.col("conv_id"))
    begun = F.slice(F.coalesce("lent_turns", F.slice("turns", 1, 0)), F.lit(1), n)
    own = F.slice("turns", n + 1, F.greatest(F.size("turns") - n, F.lit(0)))
    whole = convs.join(firsts, "family", "left").select("conv_id", F.concat(begun, own).alias("turns"))
    return whole.select("conv_id", F.array_join("turns.key", "").alias("path"), F.col("turns.bytes").alias("bytes"))


class SearchTree:
    """A ternary search tree over sequences of small numbers.

    Node 0 is the root of the trie and stands for no number. `middle` leads to the tree of a node's
    children, `lower` and `upper` to the rest of the tree that a node lies in.
    """

    def __init__(self):
        self.number, self.middle, self.lower, self.upper = [-1], [0], [0], [0]

    def _new(self, number: int) -> int:
        for column, value in ((self.number, number), (self.middle, 0), (self.lower, 0), (self.upper, 0)):
            column.append(value)
        return len(self.number) - 1

    def insert(self, sequence: list[int]) -> int:
        """The node where the sequence ends."""
        above = 0
        for number in sequence:
            links, at = self.middle, above
            while links[at]:
                at = links[at]
                if number == self.number[at]:
                    break
                links = self.lower if number < self.number[at] else self.upper
            else:
                links[at] = at = self._new(number)
            above = at
        return above

    def insert_sorted(self, sequences: list[list[int]]) -> list[int]:
        """End nodes of sorted distinct sequences, put in by medians."""
        ends = [0] * len(sequences)
        ranges = [(0, len(sequences))]
        while ranges:
            a, b = ranges.pop()
            if a < b:
                middle = (a + b) // 2
                ends[middle] = self.insert(sequences[middle])
                ranges += [(middle + 1, b), (a, middle)]
        return ends

    def preorder(self) -> Iterator[tuple[int, int]]:
        """Each node and its parent, a node before its children and these in rising order."""
        yield 0, -1
        waiting = [(self.middle[0], 0, False)] if self.middle[0] else []
        while waiting:
            at, parent, lower_done = waiting.pop()
            if not lower_done:
                waiting.append((at, parent, True))
                if self.lower[at]:
                    waiting.append((self.lower[at], parent, False))
                continue
            yield at, parent
            if self.upper[at]:
                waiting.append((self.upper[at], parent, False))
            if self.middle[at]:
                waiting.append((self.middle[at], at, False))


def digests(path: bytes) -> Iterator[str]:
    """Of every prefix of a path, the empty one first."""
    state = hashlib.sha256()
    yield state.hexdigest()[:KEY]
    for k in range(0, len(path), KEY):
        state.update(path[k : k + KEY])
        yield state.hexdigest()[:KEY]


def shard_rows(shard: int, convs: np.ndarray, paths: list[bytes], sizes: list[np.ndarray]) -> Iterator[dict[str, list]]:
    """Nodes of one shard, whose rows are sorted by path and conversation, and pieces of the ends of boundary nodes."""
    keys, coded = np.unique(np.frombuffer(b"".join(paths), dtype=f"S{KEY}"), return_inverse=True)
    counts = np.array([len(p) // KEY for p in paths])
    offsets = np.concatenate([[0], np.cumsum(counts)]).tolist()
    bounds = [0, *(i for i in range(1, len(paths)) if paths[i] != paths[i - 1])]
    coded = coded.tolist()
    tree = SearchTree()
    ends = tree.insert_sorted([coded[offsets[i] : offsets[i + 1]] for i in bounds])
    size = len(tree.number)
    rows_at = {end: (a, b) for end, a, b in zip(ends, bounds, [*bounds[1:], len(paths)])}

    order, parent, depth = [], [-1] * size, [0] * size
    for node, above in tree.preorder():
        order.append(node)
        parent[node] = above
        depth[node] = depth[above] + 1 if above >= 0 else 0
    least, members, children, leaves, own = [None] * size, [0] * size, [0] * size, [0] * size, [0] * size
    for end, (a, b) in rows_at.items():
        least[end], members[end] = int(convs[a:b].min()), b - a
        at = end
        for bytes_ in reversed(sizes[a].tolist()):  # the turns of one path; a node is met until its bytes are known
            if own[at] < 0:
                break
            own[at] = -1 - bytes_
            at = parent[at]
    own = [-1 - x if x < 0 else 0 for x in own]
    total, once = [0] * size, own.copy()
    for node in reversed(order):
        if not children[node]:
            leaves[node] = 1
        total[node] += members[node] * own[node]
        above = parent[node]
        if above >= 0:
            children[above] += 1
            leaves[above] += leaves[node]
            members[above] += members[node]
            total[above] += total[node]
            once[above] += once[node]
            least[above] = least[node] if least[above] is None else min(least[above], least[node])

    def chain(end: int) -> list[int]:
        found = []
        while end >= 0:
            found.append(end)
            end = parent[end]
        return found[::-1]

    named, first_sum = {}, {}
    for path, nodes in ((paths[-1], chain(ends[-1])), (paths[0], chain(ends[0]))):
        running = 0
        for name, node in zip(digests(path), nodes):
            named[node] = name
            running += own[node]
            if nodes[-1] == ends[0]:
                first_sum[node] = running
    last = set(chain(ends[-1]))
    out = {c: [] for c in NAMES}
    for node in order:
        a, b = rows_at.get(node, (0, 0))
        inner = node not in named
        above = parent[node]
        row = (shard, depth[node], least[node], least[above] if above >= 0 else None, members[node], children[node],
               leaves[node], total[node], once[node],
               hashlib.sha256(",".join(map(str, convs[a:b].tolist())).encode()).hexdigest() if inner else None,
               named.get(node), named.get(above), first_sum.get(node), own[node], node in last, None, None)
        for c, value in zip(NAMES, row):
            out[c].append(value)
        if not inner:
            for k in range(a, b, PIECE):
                piece = dict.fromkeys(NAMES) | {"shard": shard, "node": named[node], "piece": k,
                                                "ids": ",".join(map(str, convs[k : min(k + PIECE, b)].tolist()))}
                for c in NAMES:
                    out[c].append(piece[c])
    yield out


def shards(paths: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Node rows and ends of boundary nodes (those with a piece number) of all shards."""
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]])
                        for c in NODES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        convs, paths, sizes, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for found in shard_rows(shard, np.array(convs, dtype=np.int64), paths, sizes):
                yield from pa.Table.from_pydict(found, schema=schema).to_batches(max_chunksize=50_000)

        for batch in batches:
            lists = batch["bytes"]
            values, at = lists.flatten().to_numpy(zero_copy_only=False), 0
            for conv, path, n in zip(batch["conv_id"].to_pylist(), batch["path"].to_pylist(), lists.value_lengths().to_pylist()):
                if held and held + n > block_turns:
                    yield from flush()
                    convs, paths, sizes, held, shard = [], [], [], 0, shard + 1
                convs.append(conv)
                paths.append(path.encode())
                sizes.append(values[at : at + n])
                held, at = held + n + 1, at + n
        if convs:
            yield from flush()

    ranged = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ranged.select("conv_id", "path", "bytes").mapInArrow(run, NODES)


def _ends(pieces: DataFrame) -> DataFrame:
    """node, ends_sha256: SHA-256 over the ids of a node, its pieces one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"node": [at], "ends_sha256": [state.hexdigest()]})

        for batch in batches:
            for node, ids in zip(batch["node"].to_pylist(), batch["ids"].to_pylist()):
                if node != at:
                    if state is not None:
                        yield result()
                    at, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state is not None:
            yield result()

    ordered = pieces.repartition("node").sortWithinPartitions("node", "shard", "piece")
    return ordered.select("node", "ids").mapInArrow(run, "node string, ends_sha256 string")


def prefix_trie(df: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = durable(rebuilt(df), "conversation_paths")
    rows = durable(shards(paths, block_turns), "trie_shards")
    nodes = rows.where("piece IS NULL")
    inner, edge = nodes.where("node IS NULL"), nodes.where("node IS NOT NULL")

    # One row per shard, in order; the root is on every first path.
    order = Window.orderBy("shard")
    known = edge.where("depth = 0").select("shard").withColumns(
        {"before": F.lag("shard").over(order), "after": F.lead("shard").over(order)})
    lasts = edge.where("is_last").select(F.col("shard").alias("before"), "node")
    ends = edge.where("is_last").groupBy("shard").agg(F.max("depth").alias("last_depth"))
    agreed = (
        edge.where("first_sum IS NOT NULL").join(known, "shard").join(lasts, ["before", "node"])
        .groupBy("shard").agg(F.max("depth").alias("common"), F.max("first_sum").alias("common_bytes"))
    )
    following = known.join(agreed.select(F.col("shard").alias("after"), F.col("common").alias("common_after")), "after")
    shared = durable(
        known.select("shard").join(agreed, "shard", "left")
        .join(following.select("shard", "common_after"), "shard", "left").join(ends, "shard"), "shard_borders")

    depth, on_first = F.col("depth"), F.col("first_sum").isNotNull()
    counted = on_first & (depth <= F.col("common"))  # the shard before has this node
    zero = F.lit(0).cast("long")
    merged = edge.join(shared, "shard").select(
        "node", "depth", "conv_id", "parent_node", "n_convs", "total_bytes",
        (F.col("n_children") - F.when(on_first & (depth + 1 <= F.col("common")), 1).otherwise(0)).alias("n_children"),
        (F.col("n_leaves") - F.when(F.col("is_last") & (F.col("common_after") >= F.col("last_depth")), 1).otherwise(0))
        .alias("n_leaves"),
        (F.col("once_bytes") - F.when(counted, F.col("common_bytes") - F.col("first_sum") + F.col("own_bytes"))
         .otherwise(zero)).alias("once_bytes"))
    summed = merged.groupBy("node", "depth", "parent_node").agg(
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "total_bytes", "once_bytes")])
    none = F.sha2(F.lit(""), 256)
    borders = durable(
        summed.join(_ends(rows.where("piece IS NOT NULL")), "node", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", none)), "trie_borders")

    columns = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "total_bytes", "once_bytes", "ends_sha256", "parent_node"]
    whole = inner.select(*columns, "parent_conv_id").unionByName(
        borders.select(*columns, F.lit(None).cast("long").alias("parent_conv_id")))
    above = borders.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("above"))
    return whole.join(above, "parent_node", "left").select(
        "conv_id", "depth", F.coalesce("above", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", (F.col("total_bytes") - F.col("once_bytes")).alias("saved_tokens"), "ends_sha256")
