"""Operator 13 against a plain trie."""

import hashlib
import random
import zlib

import pytest

from larder.llm import prefix_trie
from larder.llm.queries import ORACLE, QUERIES
from tests.compare import connect, differences

SCHEMA = "conv_id long, turn long, role string, text string, path string, node string"


def plain_trie(rows):
    """Every node as a tuple, by walking over all prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            whole = f"{len(role.encode())} {role}{text}".encode()
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(whole).hexdigest()[:32], role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = {}, {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ids = ",".join(map(str, sorted(ends.get(path, []))))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children), len(leaves),
                    saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **options):
    order = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[c] for c in order) for r in prefix_trie.prefix_trie(df, **options).collect()), key=str)


@pytest.fixture(scope="module")
def build(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def made(seed, n):
    """Few texts, so that prefixes are shared at all depths and many conversations are alike."""
    pick = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(pick.choice([1, 2, 3, 5, 12])):
            rows.append((c, t, pick.choice(["user", "assistant"]) if t > 2 else "user", pick.choice(["a", "bé", "", None, "long " * 9])))
    return rows


@pytest.mark.parametrize("block", [1, 7, 200_000])
def test_equals_plain(build, block):
    rows = made(1, 60)
    assert found(build(rows), block_turns=block) == plain_trie(rows)


def test_copies_over_many_shards(spark, build):
    rows = [(c, t, "user", "the same") for c in range(0, 400, 5) for t in range(10)]
    rows += [(c, t, "user", f"own {c}") for c in range(1000, 1020) for t in range(3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert found(build(rows), block_turns=25) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(build):
    rows = [(None, 0, "user", "no conversation"), (3, None, None, None), (3, 1, "user", "x" * 100_000), (3, 1, "user", "x" * 100_000),
            (3, 2, "user", "z"), (3, 2, "user", "y"), (0, 5, "", "tie"), (0, None, "user", "first"), (7, 0, "user", "alone"),
            (8, 0, "a", "bc"), (8, 1, "ab", "c"), *[(10, t, "user", f"turn {t % 3}") for t in range(120)], (11, 0, "user", "of ten")]
    assert found(build(rows)) == plain_trie(rows)
    assert found(build(rows), block_turns=50) == plain_trie(rows)


def test_no_rows(build):
    assert found(build([])) == []


def test_search_tree_is_balanced():
    tree = prefix_trie.SearchTree()
    tree.insert_sorted([[k] for k in range(1023)])

    def height(at):
        return 1 + max(height(tree.lower[at]), height(tree.upper[at])) if at else 0

    assert height(tree.middle[0]) == 10
    assert [tree.number[n] for n, _ in tree.preorder()] == [-1, *range(1023)]


def test_equals_sql(spark, folder):
    assert differences(QUERIES["op13_prefix_trie"](spark, folder), connect(folder), ORACLE["op13_prefix_trie"]) == []
