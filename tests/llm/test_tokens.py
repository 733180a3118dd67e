"""Operators 1, 6 and 10 against the library itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larder.llm import chunk_bpe, packing, token_files
from larder.llm.encoding import PiecewiseEncoder, vocabulary_text, with_end
from larder.session import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")
CHARACTERS = "abcXYZéÉßüΣσς 0123.,;!?'\n\t\x0b\x1c\u0085　́<|>=/İK中文😀-_"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(3)
    return ["".join(pick.choice(CHARACTERS) for _ in range(pick.randint(0, 200))) for _ in range(1500)] + [
        "a<|endoftext|>b <|ENDOFTEXT|> c", "don't DON'T 'tis", " lead", "", "\n", None]


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kind", [PiecewiseEncoder, lambda v: PiecewiseEncoder(v, most_pieces=50)])
def test_piecewise_equals_library(library, texts, kind):
    encoder = kind(vocabulary_text(PATH))
    for part in (texts[:700], texts[700:]):
        found = encoder.encode(pa.array(part, pa.string()))
        assert [found.ids[a:b].tolist() for a, b in zip(found.offsets, found.offsets[1:])] == [ids(library, t) for t in part]


def test_latin_capitals_marks_and_signs_equal_library(library):
    pick = random.Random(8)
    signs = "ÀÉÖØÞÝàéöøþÿß×÷µªaZjJ'.,!-\u0301\u030c\u0331\u0308İŸ"
    words = ["".join(pick.choice(signs) for _ in range(pick.randint(1, 7))) for _ in range(6000)]
    texts = [" ".join(words[i : i + 12]) for i in range(0, len(words), 6)]
    encoder = PiecewiseEncoder(vocabulary_text(PATH))
    for part in (texts[:300], texts[300:]):
        found = encoder.encode(pa.array(part))
        assert [found.ids[a:b].tolist() for a, b in zip(found.offsets, found.offsets[1:])] == [ids(library, t) for t in part]


def test_sentence_ends_follow_end_ids():
    found = with_end(PiecewiseEncoder(vocabulary_text(PATH)).encode(pa.array(["One. Two", "", "Three."])), 2)
    assert found.ids[found.offsets[1:] - 1].tolist() == [2, 2, 2] and found.offsets[-1] == len(found.ids)
    assert found.sentence_ends.tolist() == [2, len(found.ids) - 1]  # one . | two 2 2 three . | 2


@pytest.mark.parametrize("mean", [8, 64, 512])
def test_chunks_equal_library(library, texts, mean):
    encoder = chunk_bpe.ChunkEncoder(vocabulary_text(PATH), mean, most_bytes=20_000)
    doubled = texts + texts
    found, offsets = encoder.encode(pa.array(doubled, pa.string()))
    assert [found[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [ids(library, t) for t in doubled]
    assert encoder.encoded < encoder.chunks


def test_cuts_depend_on_nearby_bytes_only():
    pick = random.Random(1)
    shared = "".join(pick.choice("abcdef ") for _ in range(4000))

    def cuts(text):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return set(chunk_bpe.pieces(data, np.array([0, len(data)]), chunk_bpe.gear(), 64).tolist())

    plain, moved = cuts(shared), {c - 100 for c in cuts("z" * 99 + " " + shared)}
    assert {c for c in plain if c > 200} <= moved and len(plain) > 20


def test_encode_and_decode(odd, empty, library):
    rows = chunk_bpe.encode_and_decode(odd, PATH).collect()
    wanted = sorted((r.doc_id or -1, ids(library, r.text)) for r in odd.collect())
    assert sorted((r.doc_id or -1, r.ids) for r in rows) == wanted
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in rows)
    assert chunk_bpe.encode_and_decode(empty, PATH).collect() == []


def test_files_round_trip(spark, odd, library):
    path = fresh_path(spark, "test_files")
    token_files.write_token_files(odd, path, PATH, end_id=1, length=64)
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in odd.collect()], key=lambda i: (i is not None, i or 0))
    place = 0
    by_id = defaultdict(list)
    for r in rows:
        found = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert r.start == place and r.n_tokens == len(found)
        place += len(found)
        by_id[r.doc_id].append(found)
    wanted = defaultdict(list)
    for r in odd.collect():
        wanted[r.doc_id].append(ids(library, r.text) + [1])
    assert {k: sorted(v) for k, v in by_id.items()} == {k: sorted(v) for k, v in wanted.items()}


def test_files_are_views(spark, odd):
    path = fresh_path(spark, "test_views")
    part = token_files.write_token_files(odd, path, PATH, length=64).orderBy("part").first()
    opened = token_files.TokenPart.open(part.path)
    before = pa.total_allocated_bytes()
    tokens, mask = opened.sequence(0)
    assert tokens.shape == (64,) and tokens.dtype == np.uint16 and not tokens.flags.owndata
    assert pa.total_allocated_bytes() - before < 1 << 16 and mask[0]
    assert part.sequences == -(-part.tokens // 64)


def test_files_of_no_rows(spark, empty):
    path = fresh_path(spark, "test_none")
    assert token_files.write_token_files(empty, path, PATH).count() == 0
    assert token_files.read_token_files(spark, path).collect() == []


def plainly_best(places, penalty, costs):
    at, extra = [0, *places], [0, *penalty]
    best = [0]
    for j in range(1, len(at)):
        sizes = [(at[j] - at[i], i) for i in range(j) if at[j] - at[i] <= costs.capacity]
        best.append(extra[j] + min(best[i] + packing.padding(size, costs.capacity) for size, i in sizes))
    return best[-1]


def test_cuts_are_the_cheapest():
    pick = random.Random(5)
    costs = packing.Costs(capacity=64, sentence_penalty=5, inner_penalty=20, grid=8, closest=1, least_power=1)
    for _ in range(60):
        ends = np.cumsum([pick.randint(1, 90) for _ in range(12)])
        sentences = np.unique([pick.randint(1, int(ends[-1])) for _ in range(40)])
        places, penalty = packing.cut_places(ends, sentences, costs)
        cuts = packing.best_cuts(places, penalty, costs)
        charge = dict(zip(places.tolist(), penalty.tolist()))
        sizes = np.diff([0, *cuts])
        assert cuts[-1] == ends[-1] and sizes.max() <= 64
        cost = sum(charge[c] + packing.padding(int(s), 64) for c, s in zip(cuts, sizes))
        assert cost == plainly_best(places.tolist(), penalty.tolist(), costs)


@pytest.mark.parametrize("block", [300, 1 << 18])
def test_pieces(odd, empty, library, block):
    costs = packing.Costs(capacity=256, block=block, least_power=16)
    rows = packing.pack(odd, PATH, 2, costs=costs).orderBy("sequence_id", "offset").collect()
    fill, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        assert r.offset == fill[r.sequence_id] and r.length == len(r.ids) // 4
        fill[r.sequence_id] += r.length
        if r.start == 0:
            pieces[r.doc_id].append([])
        pieces[r.doc_id][-1].append(r)
    assert max(fill.values()) <= 256
    for doc, copies in pieces.items():
        wanted = sorted(ids(library, t.text) + [2] for t in odd.collect() if t.doc_id == doc)
        assert sorted([x for r in c for x in np.frombuffer(r.ids, "<u4").tolist()] for c in copies) == wanted
        assert all(r.doc_tokens == sum(x.length for x in c) for c in copies for r in c)
    assert packing.pack(empty, PATH).collect() == []


def test_padding_is_small(spark, folder):
    rows = packing.pack(spark.read.parquet(f"{folder}/documents.parquet").coalesce(1), PATH)
    seen = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("padded_length").alias("p"))
    total = seen.agg(F.sum("n"), F.sum("p")).first()
    assert total[1] <= 1.03 * total[0]


def test_crc_is_unsigned(spark):
    data = np.array([1, 70000], dtype="<u4").tobytes()
    assert spark.range(1).select(F.crc32(F.lit(data))).first()[0] == zlib.crc32(data)


CAPITALS_AND_MARKS = [f"{chr(c)}{chr(m)}amza {chr(c)}x{chr(m)}" for c in range(65, 91) for m in range(0x300, 0x370)]


def test_marks_after_capitals(spark, make, library):
    """The library composes a mark with its letter before it takes capitals for small letters."""
    encoder = PiecewiseEncoder(vocabulary_text(PATH))
    found = encoder.encode(pa.array(CAPITALS_AND_MARKS))
    assert [found.ids[a:b].tolist() for a, b in zip(found.offsets, found.offsets[1:])] == [ids(library, t) for t in CAPITALS_AND_MARKS]
    rows = make(list(enumerate(CAPITALS_AND_MARKS)))
    for r in chunk_bpe.encode_and_decode(rows, PATH).collect():
        assert r.ids == ids(library, CAPITALS_AND_MARKS[r.doc_id])
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    for r in packing.pack(rows, PATH, 2).where("length = doc_tokens").collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == ids(library, CAPITALS_AND_MARKS[r.doc_id]) + [2]
    path = fresh_path(spark, "test_marks")
    token_files.write_token_files(rows, path, PATH, end_id=1, length=64)
    for r in token_files.read_token_files(spark, path).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == ids(library, CAPITALS_AND_MARKS[r.doc_id]) + [1]
