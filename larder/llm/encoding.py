"""Token ids of whole texts, equal to those of the tokenizers library.

The vocabularies meant here drop white space, so the ids of a text are those of its words in
order. Each batch is split at ASCII white space, its distinct words go to the library once, and
their ids are laid out by array operations. `PiecewiseEncoder` keeps what it has learned while a
task lasts, up to a fixed number of words; it then starts anew, which changes no result.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words of these letters, and runs of these signs, are single units of the vocabulary's splitting
# rule. The apostrophe is left out, because it can begin a contraction.
LETTERS = "[a-zß-öø-ÿ]+"
SIGNS = r"[!-&(-/:-@\[-`{-~]+"
FOLDED = "^[!-~À-ÖØ-öø-ÿ]+$"
SENTENCE_END = r"[.!?][)\"'\]]*$"
M_MMAP_THRESHOLD = -3  # as in malloc.h


def ragged(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    places = np.arange(int(ends[-1]) if len(ends) else 0)
    places += np.repeat(starts - (ends - lengths), lengths)
    return pool[places]


def laid_out(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """ragged(pool, starts[codes], lengths[codes]) with the places of few codes at a time, which take ten times what the ids take."""
    runs = (codes[i : i + at_once] for i in range(0, len(codes), at_once))
    return np.concatenate([pool[:0], *(ragged(pool, starts[run], lengths[run]) for run in runs)])


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def places(wanted: pa.Array, known: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where distinct values stand in `known`, and those missing there, which get the places after it in their order."""
    found = pc.index_in(wanted, value_set=known)
    missing = pc.is_null(found)
    which = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    new = wanted.filter(missing)
    which[which < 0] = len(known) + np.arange(len(new))
    return which, new


def slices(texts: pa.Array, most_bytes: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // most_bytes
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    yield from ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


def give_back() -> None:
    """Return freed memory to the system. Workers live on from stage to stage, and the C library and Arrow keep what they freed.

    From the first call on, arrays of 256 KB and more lie apart from small objects, which else hold their pages.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        library = ctypes.CDLL(None)
        library.mallopt(M_MMAP_THRESHOLD, 1 << 18)
        library.malloc_trim(0)


@dataclass
class Encoded:
    ids: np.ndarray  # of all texts, one after the other
    offsets: np.ndarray  # of the texts in ids, one more than texts
    sentence_ends: np.ndarray  # positions in ids after a word that ends a sentence


class PiecewiseEncoder:
    """vocabulary: the tokenizers library's JSON text; most_pieces bounds the words that are remembered."""

    def __init__(self, vocabulary: str, most_pieces: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.word_end = getattr(self.library.model, "end_of_word_suffix", None)
        if not self.word_end:
            raise ValueError("the vocabulary must mark word ends")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        names = self.library.get_vocab(with_added_tokens=True)
        self.size = max(names.values()) + 1
        self.ends_word = np.zeros(self.size, dtype=bool)
        for name, i in names.items():
            self.ends_word[i] = name.endswith(self.word_end)
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.most_pieces = most_pieces
        self._forget()
        del names
        give_back()  # reading the vocabulary takes several times what it leaves

    def _forget(self) -> None:
        self.words, self.pieces = (pa.array([], pa.large_string()) for _ in range(2))
        self.pool = np.zeros(0, dtype=self.kind)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.word_pool = np.zeros(0, dtype=self.kind)
        self.word_starts = np.zeros(0, dtype=np.int64)
        self.word_lengths = np.zeros(0, dtype=np.int64)

    def encode(self, texts: pa.Array) -> Encoded:
        """Null texts count as empty."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        bounds = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        del words
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        if not len(codes):
            return Encoded(self.pool[:0], np.zeros(len(texts) + 1, dtype=np.int64), np.zeros(0, dtype=np.int64))
        starts, lengths, pool = self._words(distinct)
        ids = laid_out(pool, starts, lengths, codes)
        after = offsets_of(lengths[codes])
        ends = pc.match_substring_regex(distinct, SENTENCE_END).to_numpy(zero_copy_only=False)
        return Encoded(ids, after[bounds - bounds[0]], after[1:][ends[codes]])

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and pool of the ids of distinct words; each word is taken apart once as long as it is remembered."""
        if len(self.words) + len(words) > self.most_pieces:
            self._forget()
        which, new = places(words, self.words)
        if len(new):
            starts, lengths, pool = self._take_apart(new)
            begin = len(self.word_pool)
            self.words = pa.concat_arrays([self.words, new])
            self.word_pool = np.concatenate([self.word_pool, pool])
            self.word_starts = np.concatenate([self.word_starts, begin + starts])
            self.word_lengths = np.concatenate([self.word_lengths, lengths])
        return self.word_starts[which], self.word_lengths[which], self.word_pool

    def _take_apart(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of words that are not yet remembered.

        Small letters stand for capitals in words of ASCII and composed Latin letters only: elsewhere the library
        composes marks with the letter before them first, and a capital may have no composed form where the small
        letter has one.
        """
        folded = pc.replace_substring_regex(pc.utf8_lower(words), f"^({LETTERS})({SIGNS})$", r"\1 \2")
        folded = pc.if_else(pc.match_substring_regex(words, FOLDED), folded, words)
        for token in self.added:  # these are looked for in the unchanged text
            folded = pc.if_else(pc.match_substring(words, token, ignore_case=True), words, folded)
        pieces = pc.split_pattern(folded, " ")
        coded = pieces.flatten().dictionary_encode()
        which, bounds = self._slots(coded.dictionary)[coded.indices.to_numpy()], pieces.offsets.to_numpy()
        counts = self.lengths[which]
        pool, after = ragged(self.pool, self.starts[which], counts), offsets_of(counts)
        starts = after[bounds[:-1]]
        return starts, after[bounds[1:]] - starts, pool

    def _slots(self, pieces: pa.Array) -> np.ndarray:
        which, new = places(pieces, self.pieces)  # every piece belongs to a word that counts as well
        if len(new):
            before = len(self.pieces)
            self._learn(new.to_pylist())
            learned = pc.index_in(new, value_set=self.pieces[before:]).to_numpy()
            which[which >= before] = before + learned
        return which

    def _learn(self, pieces: list[str]) -> None:
        """Ask the library for the ids of new pieces.

        Pieces that are one unit each go in lines of 256; the ids that end a word show where
        a piece ends. Other pieces, and lines where the counts differ, go one by one.
        """
        whole = pc.match_substring_regex(pa.array(pieces), f"^({LETTERS}|{SIGNS})$").to_numpy(zero_copy_only=False)
        plain = [p for p, ok in zip(pieces, whole) if ok]
        single = [p for p, ok in zip(pieces, whole) if not ok]
        names: list[str] = []
        parts: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        lines = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for line, found in zip(lines, self._ask([" ".join(line) for line in lines])):
            ends = np.flatnonzero(self.ends_word[found]) + 1
            if len(ends) != len(line) or (len(found) and ends[-1] != len(found)):
                single += line
                continue
            names += line
            parts.append(found)
            lengths.append(np.diff(ends, prepend=0))
        for found in self._ask(single):
            parts.append(found)
            lengths.append(np.array([len(found)]))
        names += single
        added = np.concatenate(lengths)
        begin = len(self.pool)
        self.pieces = pa.concat_arrays([self.pieces, pa.array(names, pa.large_string())])
        self.pool = np.concatenate([self.pool, *parts])
        self.starts = np.concatenate([self.starts, begin + offsets_of(added)[:-1]])
        self.lengths = np.concatenate([self.lengths, added])

    def _ask(self, texts: list[str]) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), 64):
            for e in self.library.encode_batch_fast(texts[i : i + 64], add_special_tokens=False):
                yield np.array(e.ids, dtype=self.kind)


def with_end(found: Encoded, end_id: int) -> Encoded:
    """The same texts with an end id after each."""
    texts = len(found.offsets) - 1
    ids = np.insert(found.ids, found.offsets[1:], end_id)
    shift = np.searchsorted(found.offsets[1:], found.sentence_ends, side="left")  # ends before its own
    return Encoded(ids, found.offsets + np.arange(texts + 1), found.sentence_ends + shift)


def vocabulary_text(path: str) -> str:
    """A vocabulary file of a few MB, read where the session runs and sent along with the job."""
    with open(path, encoding="utf-8") as file:
        return file.read()
