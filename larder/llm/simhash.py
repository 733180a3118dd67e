"""SimHash near-duplicates by anchor-point covering (operator 2).

A document's 64-bit fingerprint has a bit set when more than half of its shingles' hashes have it.
Two fingerprints link when they differ in at most `threshold` (4) bits. Then one of their halves
differs in at most 2 bits. Within a half, 31 bits are covered by the perfect Hamming code of length
31, whose 2**26 words lie within one bit of every point; the 32nd bit is part of the anchor as it
is. Fingerprints that differ in 2 bits have a point in between, one bit from either, and that
point's anchor is at most 1 + 1 bits from both. So each half is copied to every anchor within the
covering radius plus its part of the threshold, 2 bits: 17 anchors, or 2 for a code word itself. Two
fingerprints that link always meet at an anchor, and at each anchor the fingerprints are compared.

* All comparisons are between distinct fingerprints; copies of a text are one row with a count.
* An anchor with more than `tile` fingerprints is dealt into tiles: every pair of its parts is one
  task's group of at most 2 * tile rows. Nothing is dropped.
* A group gives the links of a spanning forest, not all pairs.
* Links become components by alternating large-star and small-star steps; each step's edges are
  written to the shared folder, so an executor's loss costs a re-read.

Defined cases: a null or empty text has no shingles and fingerprint zero, which links like any
other; fewer words than a shingle give one shingle of all words; null ids are kept, and a component
of only null ids has a null component_id; repeated ids are separate rows; an empty table gives no
rows; other columns are ignored by `near_duplicates` and kept by `deduplicate`.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.chunk_recipes import free_name
from larder.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 4
SEED = 42
THRESHOLD = 4  # the covering above is made for this number
CODED_BITS = 31
TILE = 4096


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, slice_size: int = 1 << 16) -> int:
    """64 bits; shingles are hashed from the normalised text's own bytes, a slice at a time."""
    parts = (text or "").encode().lower().split()  # of bytes: A-Z only, ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    width = min(words, len(parts))
    begin = starts[: len(parts) - width + 1].tolist()
    end = (starts + sizes)[width - 1 :].tolist()
    count = np.zeros(64, dtype=np.int64)
    hashed = xxhash.xxh64_intdigest
    for k in range(0, len(begin), slice_size):
        found = [hashed(joined[a:b], SEED) for a, b in zip(begin[k : k + slice_size], end[k : k + slice_size])]
        bits = np.unpackbits(np.array(found, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(begin), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _flips() -> np.ndarray:
    """For each syndrome of the code, the changes of a half that lead to its anchors (17, or 2 repeated).

    Bit p of a half, p = 1..31, has the label p, and bit 0 is the free one. A set of changed bits leads
    to a code word when the labels' exclusive or is the syndrome.
    """
    out = np.zeros((32, 17), dtype=np.uint64)
    for s in range(32):
        pairs = [(1 << i) | (1 << (i ^ s)) for i in range(1, 32) if i < (i ^ s)] if s else []
        found = [1 << s, (1 << s) | 1, *pairs] if s else [0, 1]
        out[s] = (found + [0] * 17)[:17]
    return out


FLIPS = _flips()
LABEL_MASKS = [sum(1 << p for p in range(1, CODED_BITS + 1) if p >> k & 1) for k in range(5)]


def anchors(half: np.ndarray) -> np.ndarray:
    """The anchors of 32-bit halves, a row of 17 each; code words repeat one of their two."""
    syndrome = np.zeros(len(half), dtype=np.int64)
    for k, mask in enumerate(LABEL_MASKS):
        syndrome |= (np.bitwise_count(half & np.uint64(mask)).astype(np.int64) & 1) << k
    return half[:, None] ^ FLIPS[syndrome]


def copies(fps: DataFrame) -> DataFrame:
    """key (which half, and anchor) and fp: each fingerprint at its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 14):
                signed = batch["fp"][k : k + (1 << 14)].to_numpy()
                fp = signed.view(np.uint64)
                for table, half in enumerate((fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32))):
                    at = anchors(half)
                    new = np.ones(at.shape, dtype=bool)
                    new[:, 2:] = at[:, 2:] != at[:, :1]  # the filling repeats the first
                    keys = (at | np.uint64(table << 32)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[new]), pa.array(np.repeat(signed, new.sum(axis=1)))], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect a group's fingerprints as all its near pairs do: those of a walk from each first."""
    links = []
    left = fp
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= THRESHOLD
            found = left[near]
            if len(found):
                links += [(int(at), int(x)) for x in found]
                front += list(found)
                left = left[~near]
    return links


def links(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """Pairs a, b of distinct fingerprints within the threshold, enough to connect all that link."""
    spark = fps.sparkSession
    placed = copies(fps)
    hot = placed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    parted = durable(hot.select("key", F.ceil(F.col("n") / tile).cast("int").alias("parts")), "hot_anchors")
    # A fingerprint of part p of n goes to the groups (p, q) for all q, once for each pair of parts.
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                        lambda q: F.least(part, q) * F.col("parts") + F.greatest(part, q))
    tiles = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(every))
    dealt = placed.join(parted, "key", "left").select("key", F.explode(tiles).alias("tile"), "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), dtype=np.int64)
        for batch in batches:
            rows = np.stack([batch[c].to_numpy() for c in ("key", "tile", "fp")])
            held = np.concatenate([held, rows], axis=1)
            same = (held[:2, :-1] == held[:2, 1:]).all(axis=0)
            breaks = np.flatnonzero(~same) + 1
            if not len(breaks):
                continue
            yield found(held[:, : breaks[-1]])  # the last group may go on in the next batch
            held = held[:, breaks[-1] :].copy()
        if held.shape[1]:
            yield found(held)

    def found(rows: np.ndarray) -> pa.RecordBatch:
        fp = rows[2].view(np.uint64)
        same = (rows[:2, :-1] == rows[:2, 1:]).all(axis=0)
        starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
        sizes = np.diff(np.append(starts, rows.shape[1]))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= THRESHOLD]
        pairs = [np.stack([fp[two], fp[two + 1]], axis=1)]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            near = forest(fp[s : s + n])
            if near:
                pairs.append(np.array(near, dtype=np.uint64))
        both = np.unique(np.sort(np.concatenate(pairs).view(np.int64), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.repartition(tasks, "key", "tile").sortWithinPartitions("key", "tile")
    return grouped.mapInArrow(compare, "a long, b long").distinct()


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root, the smallest node of its component, for every node of the pairs (a, b).

    One round: every node hands the smallest of itself and its neighbours to its larger neighbours
    (large star), then to its smaller ones (small star). The edges end as stars around the roots.
    """
    edges = durable(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.distinct(), "large_star")  # all edges point to a smaller node
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        handed = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = lower.select("u", F.col("m").alias("v"))
        edges = durable(handed.unionByName(own).distinct(), "small_star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components have not settled")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of the table: doc_id, fp, component_id (the smallest doc_id reachable by links)."""
    marked = durable(fingerprints(df, id_col, text_col, words), "fingerprints")
    return _components_of(marked)


def _components_of(marked: DataFrame) -> DataFrame:
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct_fingerprints")
    linked = durable(components(links(distinct)), "components")
    rooted = linked.join(distinct, F.col("node") == F.col("fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_linked = linked.join(least, "root").select(F.col("node").alias("fp"), F.col("component_id").alias("found"))
    whole = distinct.join(of_linked, "fp", "left").select("fp", F.coalesce("found", "first").alias("component_id"))
    return marked.join(durable(whole, "fingerprint_components"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each component, the first of its smallest id, with all columns."""
    number = free_name(df, "row_number_of_table")
    numbered = durable(df.withColumn(number, F.monotonically_increasing_id()), "numbered")
    # The row numbers take the part of the ids: of a component, the row of the smallest (id, number) stays.
    marked = durable(fingerprints(numbered, number, text_col, words), "fingerprints")
    grouped = _components_of(marked).withColumnRenamed("doc_id", number)
    known = numbered.select(number, F.col(id_col).cast("long").alias("own_id"))
    joined = durable(grouped.join(known, number), "members")
    order = F.struct(F.col("own_id").isNull().alias("unknown"), "own_id", F.col(number).alias("number"))
    best = durable(joined.groupBy("component_id").agg(F.min(order).alias("best"), F.count("*").alias("members")), "best")
    extra = joined.join(best.where("members > 1"), "component_id").where(
        F.col(number) != F.col("best.number"))
    return numbered.join(durable(extra.select(number), "dropped"), number, "left_anti").drop(number)


def hexadecimal(fp: Column) -> Column:
    """16 lower-case digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
