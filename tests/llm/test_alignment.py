"""Operator 11 against both libraries on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from larder.llm import alignment
from larder.llm.encoding import vocabulary_text

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment.byte_alphabet()

    def groups(text):
        """(A ids, B ids) of each group, by joined bytes only."""
        if not text:
            return []
        ids_a, ids_b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        bytes_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i)
                   else second.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return []
        out, ends, i, j, x, y = [], ([], []), 0, 0, 0, 0
        while i < len(ids_a) or j < len(ids_b):
            if x <= y:
                x += len(bytes_a[i])
                ends[0].append(ids_a[i])
                i += 1
            else:
                y += len(bytes_b[j])
                ends[1].append(ids_b[j])
                j += 1
            if x == y:
                out.append(ends)
                ends = ([], [])
        return out

    return groups


def plain_result(plain, rows):
    found = [(i, plain(t)) for i, t in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for _, g in found]
    count = Counter(p for of in links for p in set(of))
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (i, g), of in zip(found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(of),
                    sum(count[p] == top[p[0]] for p in of), sum(count[p] for p in of),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def found(df, **options):
    return sorted((tuple(r) for r in alignment.align(df, A, B, **options).collect()), key=str)


def made(seed, n):
    pick = random.Random(seed)
    signs = ["word", "Zwei", "don't", "é", "é", "中文", "。", ".", "!", "\n", "\n\n", " ", "  ", " ", " ", "\t", "😀", "𐍈", "ﬁ",
             "<|endoftext|>", "<s>", "<0x41>", "\x00", " ", "123", "ู", "​", "\x85", "\x1c", "▁"]
    usual = signs[:-1]
    return ["".join(pick.choice(signs if k % 9 == 0 else usual) for _ in range(pick.randint(0, 40))) for k in range(n)]


def test_tokens_end_where_their_bytes_do(plain):
    aligner = alignment.Aligner(vocabulary_text(A), open(B, "rb").read())
    for text in made(1, 1500):
        spans = aligner.tokens(" " + text)
        wanted = plain(text)
        if spans is None or not text:
            assert wanted == []
            continue
        _, upto_a, upto_b = aligner.groups(*spans)
        parts = [np.split(ids, upto)[:-1] for ids, upto in ((spans[0], upto_a), (spans[2], upto_b))]
        assert [(x.tolist(), y.tolist()) for x, y in zip(*parts)] == wanted


@pytest.mark.parametrize("options", [{}, {"bundle_bytes": 200, "most_units": 40}])
def test_made_texts(make, plain, options):
    texts = made(2, 400)
    rows = list(enumerate(texts + texts[:50]))
    assert found(make(rows), **options) == plain_result(plain, rows)


def test_odd_rows(odd, empty, plain):
    assert found(odd) == plain_result(plain, [(r.doc_id, r.text) for r in odd.collect()])
    assert found(empty) == []


def test_whole_table(spark, folder, plain):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    assert found(rows) == plain_result(plain, [tuple(r) for r in rows.collect()])


def test_vocabularies_are_verified():
    with pytest.raises(ValueError):
        alignment.Aligner(vocabulary_text(public_tokenizers.path("word_bpe_49k.json")), open(B, "rb").read())
