"""Operators 7 and 8, the pipeline, and the package's place in the library."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import licenses, pseudonyms
from larder.llm.queries import QUERIES
from larder.session import fresh_path
from tests.llm.test_copies import norm, plain_components, plain_fingerprint

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    work = pseudonyms.Feistel(b"k")
    assert sorted(work.permute(x, size, b"t") for x in range(size)) == list(range(size))
    if size > 50:
        assert [work.permute(x, size, b"u") for x in range(size)] != [work.permute(x, size, b"t") for x in range(size)]


def test_values_keep_their_format():
    work = pseudonyms.Pseudonyms(b"key")
    text = ("mail jane.doe7@mail.example.com or call +1 (555) 010-9999, card 4111 1111 1111 1111, iban DE89 3704 0044 0532 "
            "0130 00, ssn 123-45-6789, host 10.0.0.1, born 1980-02-29 or 29/02/1980, token = \"b44e15e09fd311c3cf3163b66d5a\".")
    new, finds = work.replace(text)
    assert sorted(f["kind"] for f in finds) == sorted(
        ["email", "phone", "card", "iban", "ssn", "ip", "date", "date", "secret"])
    for old in ("jane.doe7", "010-9999", "4111 1111 1111", "3704 0044", "123-45-6789", "10.0.0.1", "1980-02-29", "b44e15e0"):
        assert old not in new
    again, found_again = work.replace(new)
    assert [f["kind"] for f in found_again] == [f["kind"] for f in finds] and again != new
    for f in finds:
        assert new[f["start"] : f["start"] + f["length"]].strip()


def test_equal_values_stay_linked():
    work = pseudonyms.Pseudonyms(b"key")
    a, b = (work.replace(t)[0] for t in ("card 4111 1111 1111 1111", "no. 4111111111111111."))
    assert a.split(" ", 1)[1].replace(" ", "") == b.split()[1].rstrip(".")
    assert work.replace("x@a.com")[0] == work.replace("x@a.com")[0] != pseudonyms.Pseudonyms(b"other").replace("x@a.com")[0]


def test_invalid_values_are_left_alone():
    work = pseudonyms.Pseudonyms(b"key")
    for text in ("order 1219538112535716", "v 1.2.300.4", "000-12-3456", "2023-02-30", "DE00 3704 0044 0532 0130 00",
                 "pi is 3.14159265358979", "page 12 of 345", "a key = value", "", "in 1999 and 2004"):
        assert work.replace(text) == (text, [])


@pytest.mark.parametrize("kinds, text", [
    ("iban", "DE89370400440532013000 BIC COBADEFFXXX"), ("iban", "DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX"),
    ("card", "4111 1111 1111 1111 12/25"), ("card", "4111111111111111 123"), ("card", "4111-1111-1111-1111 12/25 123"),
    ("card", "no. 123 4111111111111111"), ("iban card", "DE89370400440532013000 4111 1111 1111 1111 123"),
    ("card", "v 1.2.300.4 4111111111111111"), ("email", "key=abcdefghijklmnop@example.com"),
    ("phone", "call 555 010 9999 1234 56"), ("ssn", "1234567890123456 123-45-6789"),
])
def test_values_with_neighbours_are_found(kinds, text):
    new, finds = pseudonyms.Pseudonyms(b"key").replace(text)
    assert [f["kind"] for f in finds] == kinds.split() and len(new) == len(text)
    for f in finds:
        assert new[f["start"] : f["start"] + f["length"]] != text[f["start"] : f["start"] + f["length"]]


@pytest.mark.parametrize("kinds, text", [
    ("phone", "+44 20 7946 0958"), ("phone", "+33 1 23 45 67 89"), ("phone", "+81 3-1234-5678"), ("phone", "+49 (0)30 1234567"),
    ("iban", "SA0380000000608010167519"), ("iban", "AE070331234567890123456"), ("iban", "TR330006100519786457841326"),
    ("iban", "IL620108000000099999999"), ("iban", "UA213223130000026007233566001"), ("iban", "BR1800360305000010009795493C1"),
    ("phone card", "+1 555 010 9999 4111 1111 1111 1111"), ("phone card", "+44 20 7946 0958 4111 1111 1111 1111"),
    ("phone date", "+44 20 7946 0958 2024-01-02"), ("email", "почта@example.com"), ("email", "ωμέγα7@example.com"),
])
def test_values_of_all_countries_are_found(kinds, text):
    new, finds = pseudonyms.Pseudonyms(b"key").replace(text)
    assert [f["kind"] for f in finds] == kinds.split() and len(new) == len(text)
    assert sum(f["length"] for f in finds) >= len(text.split("@")[0]) - text.count(" ")
    for f in finds:
        assert new[f["start"] : f["start"] + f["length"]] != text[f["start"] : f["start"] + f["length"]]
    if "@" in text:
        assert all(a != b for a, b in zip(new.split("@")[0][:3], text))
    assert [f["kind"] for f in pseudonyms.Pseudonyms(b"key").replace(new)[1]] == kinds.split()


def test_pseudonymise_rows(odd, empty, make):
    out = pseudonyms.pseudonymise(odd, "k")
    assert out.columns == odd.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))  # nothing personal there
    frame = make([(1, "x@example.com 10.1.2.3"), (2, None)])
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(frame, "k", finds_col="found").collect()}
    assert [f.kind for f in rows[1].found] == ["email", "ip"] and rows[2].text is None and rows[2].found is None
    assert pseudonyms.pseudonymise(empty, "k").collect() == []


def plain_longest(pairs):
    best = 0
    for bits in range(1 << len(pairs)):
        part = [b for k, (_, b) in enumerate(pairs) if bits >> k & 1]
        if part == sorted(set(part)):
            best = max(best, len(part))
    return best


def test_rising_is_longest():
    pick = random.Random(1)
    for _ in range(50):
        seconds = pick.sample(range(20), 9)
        pairs = list(enumerate(seconds))
        found = licenses.rising(pairs)
        assert len(found) == plain_longest(pairs) and [b for _, b in found] == sorted(b for _, b in found)


def test_scans(make, odd, empty):
    mit = licenses.TEMPLATES["MIT-text"]
    near = mit.replace("free of charge", "at no cost").replace("merge,", "")
    words = "some words of no meaning stand here "
    frame = make([
        (1, mit), (2, words * 50 + near + words * 50), (3, mit + "\n" + mit), (4, words * 20),
        (5, "Released under the MIT License. Licensed under CC BY-NC 4.0."), (6, None), (7, mit[: len(mit) // 2]),
        (8, "under the sea, the license of a poet")])
    found = [(r.doc_id, r.license) for r in licenses.license_scans(frame).collect()]
    assert sorted(found) == [(1, "MIT-text"), (2, "MIT-text"), (3, "MIT-text"), (3, "MIT-text"),
                             (5, "CC-BY-NC-4.0"), (5, "MIT")]
    assert licenses.license_scans(odd).collect() == [] and licenses.license_scans(empty).collect() == []


def test_planted_lines_are_found(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op8_licenses"](spark, folder).groupBy("license").count().collect()
    lines = {"GPL-3.0", "CC-BY-NC-4.0", "MIT", "Apache-2.0"}
    texts = spark.read.parquet(f"{folder}/documents.parquet")
    for r in rows:
        assert r.license in lines
        wanted = texts.select(F.sum(F.size(F.split("text", F.lit(rf"\Q{licenses.TEMPLATES[r.license]}\E"))) - 1)).first()[0]
        assert r["count"] == wanted


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns
        sizes.append(kept.count())
    assert sizes[0] == sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    packed = corpus_pipeline.run(spark, folder)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_nothing_else_imports_the_package():
    for path in [*ROOT.glob("larder/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.parts:
            assert "larder.llm" not in path.read_text()


@pytest.mark.parametrize("of", ["odd", "empty"])
def test_pipeline_equals_plain_stages(spark, request, of):
    """Nulls, empty and very long texts, ties, repeated rows and ids, number signs, personal data, no rows."""
    texts = [(r.doc_id, r.text) for r in request.getfixturevalue(of).collect()]
    if texts:
        texts += [(20, "½ ²"), (21, "12 34 !!"), (22, "Write to anna.smith@example.org or call."), (23, "HELLO there, general reader of this text."),
                  (24, "Write to anna.smith@example.org  or call. ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    folder = fresh_path(spark, "odd_documents")
    docs.write.parquet(f"{folder}/documents.parquet")
    lettered = [(i, t) for i, t in texts if any(c.isalpha() for c in t or "")]
    exact = {}
    for i, t in lettered:
        exact.setdefault(norm(t), []).append((-len(t), i is None, i or 0, i, t))
    distinct = [min(g)[3:] for g in exact.values()]
    root = plain_components(sorted({plain_fingerprint(t) for _, t in distinct}))
    near = {}
    for i, t in distinct:
        near.setdefault(root[plain_fingerprint(t)], []).append((i is None, i or 0, str(i)))
    wanted = sorted(min(g)[2] for g in near.values())
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert sorted({str(r.doc_id) for r in pieces}) == sorted(set(wanted))
    whole = [r for r in pieces if r.start == 0]
    assert sorted(str(r.doc_id) for r in whole) == wanted
    filled = {}
    for r in pieces:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 4096
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in whole)
