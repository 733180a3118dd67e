"""Operators 2 and 9 against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import chunk_recipes, simhash
from larder.llm.queries import ORACLE, QUERIES
from tests.compare import connect, differences


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_equals_sql(spark, folder):
    assert differences(QUERIES["op9_chunk_recipes"](spark, folder), connect(folder), ORACLE["op9_chunk_recipes"]) == []


@pytest.mark.parametrize("identifiers", [
    chunk_recipes.IDENTIFIERS,
    (lambda c: F.pmod(F.xxhash64(c), F.lit(2)), *chunk_recipes.IDENTIFIERS[1:]),  # clashes: the wider one is taken
])
def test_exact(odd, empty, identifiers):
    rows = chunk_recipes.duplicates(odd, identifiers=identifiers).collect()
    groups = defaultdict(list)
    for r in odd.collect():
        groups[norm(r.text)].append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    wanted = sorted((str(i), str(min(g)[2]), len(g), hashlib.sha256(t.encode()).hexdigest())
                    for t, g in groups.items() for _, _, i in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows) == wanted
    assert sum(r.kept for r in rows) == len(groups)
    assert chunk_recipes.duplicates(empty).collect() == []
    left = chunk_recipes.deduplicate(odd, identifiers=identifiers)
    assert left.columns == odd.columns and left.count() == len(groups)


def test_no_identifier_left(odd):
    with pytest.raises(ValueError):
        chunk_recipes.duplicates(odd, identifiers=[lambda c: F.lit(1)])


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints(odd):
    for r in odd.collect():
        assert simhash.fingerprint(r.text, slice_size=7 if len(r.text or "") < 100 else 5000) == plain_fingerprint(r.text)


def test_anchors_cover():
    pick = random.Random(2)
    for _ in range(300):
        x = pick.getrandbits(32)
        found = set(map(int, simhash.anchors(np.array([x], dtype=np.uint64))[0]))
        for _ in range(20):
            y = x
            for b in pick.sample(range(32), pick.randint(0, 2)):
                y ^= 1 << b
            assert found & set(map(int, simhash.anchors(np.array([y], dtype=np.uint64))[0]))
        assert all((x ^ a).bit_count() <= 2 for a in found)


def plain_components(fps):
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {f: top(f) for f in fps}


@pytest.mark.parametrize("tile", [3, 4096])
def test_links_of_a_large_group(spark, tile):
    pick = random.Random(4)
    fps = {0}
    for _ in range(25):
        f = pick.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            for b in pick.sample(range(64), pick.randint(1, 4)):
                f ^= 1 << b
    centre = pick.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 60, 6) for b in range(1, 60, 7)}
    wanted = plain_components(sorted(fps))
    signed = [(int(np.array([f], np.uint64).view(np.int64)[0]),) for f in fps]
    pairs = simhash.links(spark.createDataFrame(signed, "fp long"), tile)
    for r in pairs.collect():
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4
    found = {r.node: r.root for r in simhash.components(pairs).collect()}
    groups = defaultdict(set)
    for f in fps:
        s = int(np.array([f], np.uint64).view(np.int64)[0])
        groups[found.get(s, s)].add(f)
    plain = defaultdict(set)
    for f, r in wanted.items():
        plain[r].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_a_long_chain_settles(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = simhash.components(chain).collect()
    assert len(rows) == 201 and {r.root for r in rows} == {0}
    assert simhash.components(chain.where("a < 0")).collect() == []


def test_near(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    texts = [(r.doc_id, plain_fingerprint(r.text)) for r in odd.collect()]
    root = plain_components(sorted({f for _, f in texts}))
    least = {}
    for i, f in texts:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    wanted = sorted((str(i), f, str(least.get(root[f]))) for i, f in texts)
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in rows) == wanted
    assert simhash.near_duplicates(empty).collect() == []
    left = simhash.deduplicate(odd)
    assert left.columns == odd.columns and left.count() == len(set(root.values()))


def test_the_stage_keeps_one_of_a_component(spark, make):
    """The pipeline's stage is operator 2: one bit apart in one word of many is near, other texts stay."""
    words = [f"w{k}" for k in range(4000)]
    near = [*words[:2000], "edit", *words[2001:]]
    assert 0 <= (plain_fingerprint(" ".join(words)) ^ plain_fingerprint(" ".join(near))).bit_count() <= 4
    frame = make([(1, " ".join(words)), (2, " ".join(near)), (3, "other " * 9), (4, "Other " * 9), (5, "one more text")])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect()) == [1, 3, 5]
