"""Alignment of the tokens of two tokenizers by their spans (operator 11).

A is a byte-level BPE of the tokenizers library, B a sentencepiece model with byte fallback. Both
see a text with a space before it. Where tokens of both end at the same byte the text is cut; what lies
between two cuts is a group, and every A token of a group is linked with every B token of it.

Ends of tokens come from the libraries' spans: characters of the tokenizers library, bytes of
sentencepiece's proto (its installed release names the immutable one `proto`). These are coarse where a
token ends inside a character: tokens of A that share a character and byte tokens of B get their
end from the decoded bytes of the tokens before. The joined bytes of all tokens must be the text.

Neither splitting rule lets anything reach over a single space between two other signs, so both end a
token before such a space (`Aligner` verifies the properties of the vocabularies that this rests on). A task
therefore aligns each distinct stretch between such spaces once and puts documents together from them.

Counts of a pair over all documents need no row per document and pair: a bundle of documents (2 MB of
text) states its distinct pairs with their numbers of documents, these are summed and joined back per bundle,
and the documents of a bundle look their pairs up in it. So what is shuffled grows with distinct pairs per
bundle, and a pair that every document has is one row per bundle.

Defined cases: null and empty texts, and texts whose joined bytes differ (such as those with U+2581), have no
tokens: zeros and an empty string. Null ids and repeated ids stay rows of their own; other columns are ignored;
an empty table gives no rows. Memory: a bundle, or one document if it is longer, and the remembered
stretches, which are dropped at `most_units`; that changes no result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.encoding import offsets_of, ragged, slices, vocabulary_text
from larder.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CUT = re.compile(r"(?<=\S)(?= \S)")
PLAIN = re.compile(r" \S(?:.*\S)?", re.DOTALL)  # a stretch that may stand between others
LINE = 256  # stretches that are encoded as one text
BUNDLE_BYTES = 2 << 20
MOST_UNITS = 400_000
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
BUNDLES = ("bundle long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
           "n_links array<long>, groups_sha256 array<string>, pairs array<long>, docs array<int>, "
           "sizes array<int>, packed binary")
OUT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
       "groups_sha256 string")


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def laid_out(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in a row, and where each part begins and how long it is."""
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), offsets_of(lengths)[:-1], lengths


class Aligner:
    """vocabulary: the JSON text of A; model: the bytes of B's file."""

    def __init__(self, vocabulary: str, model: bytes, most_units: int = MOST_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocabulary)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=model)
        names = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        letters = byte_alphabet()
        bytes_a = [b""] * (names[-1][1] + 1)
        for name, i in names:
            bytes_a[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.is_byte = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        bytes_b = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(pieces, self.is_byte)]
        self.table_a, self.table_b = laid_out(bytes_a), laid_out(bytes_b)
        self.signs = laid_out([b"%d%c" % (i, sign) for i in range(len(bytes_a)) for sign in b",|"]
                              + [b"%d%c" % (i, sign) for i in range(len(bytes_b)) for sign in b",;"])
        form = json.loads(vocabulary)
        splits = form["pre_tokenizer"] or {}
        if form["normalizer"] or splits.get("type") != "ByteLevel" or not splits.get("use_regex", True):
            raise ValueError("the first vocabulary must be byte-level with the usual splitting rule")
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("the second vocabulary has pieces that go on after a space")
        self.width = len(pieces)
        self.most_units = most_units
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.strings: list[bytes] = []  # of each stretch its groups, every one with a semicolon
        self.numbers = np.zeros((0, len(NUMBERS)), dtype=np.int64)
        self.bad = np.zeros(0, dtype=bool)  # the bytes differ
        self.starts = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.int64)  # pairs a * width + b, one per link

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and byte ends of A and B over a text that begins with a space; None if their bytes differ from it."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        found = self.a.encode(text, add_special_tokens=False)
        proto = self.b.encode(text[1:], return_type="proto").pieces
        ids_a = np.array(found.ids, dtype=np.int64)
        ids_b = np.array([p.id for p in proto], dtype=np.int64)
        for table, ids in ((self.table_a, ids_a), (self.table_b, ids_b)):
            joined = ragged(table[0], table[1][ids], table[2][ids])
            if len(joined) != len(data) or (joined != data).any():
                return None
        spans = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
        inside = np.append(spans[1:, 0] < spans[:-1, 1], False)  # the next token has a part of its last character
        ends_a = spans[:, 1]
        if len(data) != len(text):
            # Bytes before each character: a character begins at each byte that does not go on with one.
            ends_a = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[ends_a]
        ends_a = np.where(inside, np.cumsum(self.table_a[2][ids_a]), ends_a)
        ends_b = np.array([p.end for p in proto], dtype=np.int64) + 1  # the space before the text
        ends_b = np.where(self.is_byte[ids_b], np.cumsum(self.table_b[2][ids_b]), ends_b)
        return ids_a, ends_a, ids_b, ends_b

    def groups(self, ids_a, ends_a, ids_b, ends_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where groups end, and how many tokens of A and of B have ended by then."""
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        return cuts, np.searchsorted(ends_a, cuts, side="right"), np.searchsorted(ends_b, cuts, side="right")

    def _learn(self, units: list[str]) -> None:
        """Align new stretches, those that may stand between others in lines."""
        fits = [PLAIN.fullmatch(u) is not None for u in units]
        plain = [u for u, ok in zip(units, fits) if ok]
        lines = [plain[k : k + LINE] for k in range(0, len(plain), LINE)]
        lines += [[u] for u, ok in zip(units, fits) if not ok]
        numbers, bad, links = [self.numbers], [self.bad], [self.pool]
        while lines:
            line = lines.pop()
            found = self.tokens("".join(line))
            if found is None and len(line) > 1:
                lines += [[u] for u in line]
                continue
            self.slot.update(zip(line, range(len(self.strings), len(self.strings) + len(line))))
            bad.append(np.full(len(line), found is None))
            if found is None:
                numbers.append(np.zeros((1, len(NUMBERS)), dtype=np.int64))
                self.strings.append(b"")
                continue
            ids_a, _, ids_b, _ = found
            cuts, upto_a, upto_b = self.groups(*found)
            n_a, n_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
            # Every token of A meets the tokens of B of its group.
            times = np.repeat(n_b, n_a)
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            links.append(np.repeat(ids_a, times) * self.width + ids_b[np.repeat(np.repeat(upto_b - n_b, n_a), times) + nth])
            # What is written: the ids of a group's A tokens, then of its B tokens, each with the sign after it.
            last_a, last_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
            last_a[upto_a - 1] = last_b[upto_b - 1] = 1
            signs = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
            signs[np.arange(len(ids_a)) + np.repeat(upto_b - n_b, n_a)] = 2 * ids_a + last_a
            signs[np.arange(len(ids_b)) + np.repeat(upto_a, n_b)] = 2 * (ids_b + len(self.table_a[1])) + last_b
            written = ragged(self.signs[0], self.signs[1][signs], self.signs[2][signs]).tobytes()
            # Stretches end where groups do.
            ends = np.searchsorted(cuts, np.cumsum([len(u.encode()) for u in line]), side="right") - 1
            upto = np.stack([upto_a, upto_b, np.arange(1, len(cuts) + 1), np.cumsum(n_a * n_b)], axis=1)[ends]
            numbers.append(np.diff(upto, axis=0, prepend=0))
            places = [0, *np.cumsum(self.signs[2][signs])[upto[:, 0] + upto[:, 1] - 1].tolist()]
            self.strings += [written[x:y] for x, y in zip(places, places[1:])]
        self.numbers, self.bad, self.pool = np.concatenate(numbers), np.concatenate(bad), np.concatenate(links)
        self.starts = offsets_of(self.numbers[:, 3])[:-1]

    def bundle(self, texts: list[str | None]) -> dict[str, object]:
        """What a bundle's documents have, and their pairs by document (see `_lookup`)."""
        units = [CUT.split(" " + t) if t else [] for t in texts]
        slot = self.slot
        new = {u for of in units for u in of if u not in slot}
        if len(new) + len(slot) > self.most_units:
            self._forget()
            slot = self.slot
            new = {u for of in units for u in of}
        if new:
            self._learn(list(new))
        counts = np.array([len(of) for of in units], dtype=np.int64)
        flat = np.array([slot[u] for of in units for u in of], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        spoilt = np.bincount(owner, weights=self.bad[flat], minlength=len(texts)) > 0
        flat, counts = flat[~spoilt[owner]], np.where(spoilt, 0, counts)
        bounds = offsets_of(counts)
        sums = np.concatenate([np.zeros((1, len(NUMBERS)), dtype=np.int64), np.cumsum(self.numbers[flat], axis=0)])
        of_document = sums[bounds[1:]] - sums[bounds[:-1]]
        pairs = ragged(self.pool, self.starts[flat], self.numbers[flat, 3])
        # One sort tells each document's distinct pairs and how often it has them.
        distinct, local = np.unique(pairs, return_inverse=True)
        owner = np.repeat(np.arange(len(texts)), of_document[:, 3])
        own, times = np.unique(owner * max(len(distinct), 1) + local, return_counts=True)
        document, local = np.divmod(own, max(len(distinct), 1))
        codes, strings = flat.tolist(), self.strings
        return {
            **{c: of_document[:, k] for k, c in enumerate(NUMBERS)},
            "groups_sha256": [
                hashlib.sha256(b"".join([strings[c] for c in codes[x:y]])[:-1]).hexdigest() if y > x else ""
                for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())],
            "pairs": distinct, "docs": np.bincount(local, minlength=len(distinct)),
            "sizes": np.bincount(document, minlength=len(texts)),
            "packed": pack(local, times),
        }


def pack(local: np.ndarray, times: np.ndarray) -> bytes:
    """Numbers of pairs, as differences, and how often; both as 32-bit integers."""
    both = np.concatenate([np.diff(local, prepend=0), times]).astype("<i4")
    return pa.compress(both.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype="<i4")
    return np.cumsum(both[:n], dtype=np.int64), both[n:].astype(np.int64)


def bundles(df: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text",
            bundle_bytes: int = BUNDLE_BYTES, most_units: int = MOST_UNITS) -> DataFrame:
    """One row per bundle of documents."""
    with open(model, "rb") as file:
        files = df.sparkSession.sparkContext.broadcast((vocabulary_text(vocabulary), file.read()))  # two files of some MB
    names = [c.split()[0] for c in BUNDLES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = None, TaskContext.get().partitionId() << 32
        for batch in batches:
            if aligner is None:
                aligner = Aligner(*files.value, most_units)
            for a, b in slices(batch["text"], bundle_bytes):
                found = aligner.bundle(batch["text"][a:b].to_pylist())
                found |= {"bundle": number, "doc_id": batch["doc_id"][a:b].to_pylist()}
                number += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([found[c]], pa.binary() if c == "packed" else pa.int64() if c == "bundle" else pa.list_(
                        pa.string() if c == "groups_sha256" else pa.int32() if c in ("docs", "sizes") else pa.int64()))
                    for c in names], names)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, BUNDLES)


def _lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counts of each document's links from its bundle's."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            known = row["known"].flatten()
            place = known.field("pos").to_numpy(zero_copy_only=False)
            count, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
            count[place] = known.field("n").to_numpy(zero_copy_only=False)
            best[place] = known.field("best").to_numpy(zero_copy_only=False)
            sizes = row["sizes"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = offsets_of(sizes)
            local, times = unpack(row["packed"][0].as_py(), int(bounds[-1]))
            sums = [np.concatenate([[0], np.cumsum(times * x[local])]) for x in (best, count)]
            n_best, count_sum = (pa.array(s[bounds[1:]] - s[bounds[:-1]], pa.int64()) for s in sums)
            yield pa.RecordBatch.from_arrays(
                [row["doc_id"].flatten(), *[row[c].flatten() for c in NUMBERS], n_best, count_sum,
                 row["groups_sha256"].flatten()], [c.split()[0] for c in OUT.split(", ")])


def align(df: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    from sentencepiece import SentencePieceProcessor

    width = SentencePieceProcessor(model_file=model).get_piece_size()
    packed = durable(bundles(df, vocabulary, model, id_col, text_col, **options), "aligned_bundles")
    listed = packed.select("bundle", F.posexplode(F.arrays_zip("pairs", "docs")).alias("pos", "p")).select(
        "bundle", "pos", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = listed.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.floor(F.col("pair") / width))
    counts = durable(counts, "pair_counts")
    tops = counts.groupBy("a").agg(F.max("n").alias("top"))
    known = counts.join(tops, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    back = listed.join(known, "pair").groupBy("bundle").agg(F.collect_list(F.struct("pos", "n", "best")).alias("known"))
    none = F.array().cast("array<struct<pos:int,n:bigint,best:boolean>>")
    met = packed.drop("pairs", "docs").join(back, "bundle", "left").withColumn("known", F.coalesce("known", none))
    return met.mapInArrow(_lookup, OUT)
