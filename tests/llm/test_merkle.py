"""Operator 12 against plain Python and SQL."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larder.llm import merkle
from larder.llm.queries import ORACLE, QUERIES
from tests.compare import connect, differences


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_sections(text):
    """Lists of paragraphs."""
    found, run = [], []
    parts = re.split(r"(?<=\n)", text)
    for k, p in enumerate(parts):
        run.append(p)
        if len(p) <= 1 or int(sha(p)[31], 16) % 8 == 0 or k == len(parts) - 1:
            found.append(run)
            run = []
    return found


def plain_root(text):
    return sha("".join(sha("".join(sha(p)[:32] for p in s))[:32] for s in plain_sections(text)))


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = (Counter(s for p in re.split(r"(?<=\n)", t) for s in re.split(r"(?<=[.!?;。！？；])", p)) for t in (a, b))
    return 2.0 * sum(min(n, y[s]) * len(s) for s, n in x.items()) / max(len(a) + len(b), 1)


def plain_result(rows):
    order = sorted(((i is None, -(i or 0), sha(t or ""), i, t or "") for i, t in rows))
    out = []
    for k, (*_, i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][-1]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        out.append((i, len(text), sha(edited), plain_root(text), plain_root(edited),
                    round(plain_likeness(text, edited), 9), round(plain_likeness(text, after), 9)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9),
                    round(r.near_next, 9)) for r in merkle.document_fingerprints(df).collect()), key=str)


def test_odd_rows(odd, empty):
    assert found(odd) == plain_result([(r.doc_id, r.text) for r in odd.collect()])
    assert found(empty) == [] and merkle.fingerprints(empty).collect() == []


def made(seed, n):
    pick = random.Random(seed)
    signs = ["word", "zwei", "é", "中文", "。", ". ", "!", "\n", "\n\n", " ", "; ", "😀"]
    return ["".join(pick.choice(signs) for _ in range(pick.randint(0, 120))) for _ in range(n)]


def test_made_texts(make):
    texts = made(3, 150)
    rows = [(pick, t) for pick, t in enumerate(texts + texts[:20])] + [(7, texts[7])] * 3
    assert found(make(rows)) == plain_result(rows)


def test_over_many_ranges(spark, make):
    rows = [(i * 3 % 101, t) for i, t in enumerate(made(4, 101))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(make(rows)) == plain_result(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_document_follows_itself(make):
    assert found(make([(4, "One. Two. Three.")])) == plain_result([(4, "One. Two. Three.")])


def test_trees(make):
    texts = made(5, 60)
    for r in merkle.fingerprints(make(list(enumerate(texts)))).collect():
        assert r.fingerprint == plain_root(texts[r.doc_id])
        assert [len(s.leaves) for s in r.tree] == [len(s) for s in plain_sections(texts[r.doc_id])]
        assert sum(s.points for s in r.tree) == len(texts[r.doc_id])


@pytest.mark.parametrize("seed", [6, 7])
def test_edits_are_located(spark, seed):
    """Outside of the span the texts agree; the span is no more than the paragraphs that the edit touches."""
    pick = random.Random(seed)
    rows = []
    for k in range(80):
        lines = [f"line {pick.randint(0, 30)} of it\n" for _ in range(pick.randint(1, 60))]
        at = pick.randrange(len(lines))
        new = [f"new {k}\n" for _ in range(pick.choice([0, 1, 4]))]
        rows.append(("".join(lines), "".join(lines[:at] + new + lines[at + 1 :])))
    df = spark.createDataFrame(rows, "x string, y string")
    a, b = merkle.tree(F.col("x")), merkle.tree(F.col("y"))
    for r in df.select("x", "y", a.alias("a"), b.alias("b")).select("x", "y", merkle.edited_span(F.col("a"), F.col("b")).alias("e")).collect():
        if r.x == r.y:
            assert r.e is None
            continue
        assert r.y.startswith(r.x[: r.e.start]) and r.y.endswith(r.x[r.e.end :])
        assert len(r.y) >= r.e.start + len(r.x) - r.e.end
        assert r.e.end - r.e.start <= 300  # one section at most is not told apart


def test_equals_sql(spark, folder):
    assert differences(QUERIES["op12_merkle"](spark, folder), connect(folder), ORACLE["op12_merkle"]) == []
