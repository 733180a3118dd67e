"""Language identification by segmentation-marginalised unigrams (operator 4).

The pieces of a fixed public vocabulary get a probability in every language. A word's probability in
a language is the sum over all its segmentations into pieces of the product of the pieces'
probabilities, computed by a forward algorithm; a text's is the product over its words. Training is
expectation maximisation: forward and backward sums give the expected use of each piece.

Words are lower-cased runs of letters; the vocabulary marks word beginnings. A character that no
piece holds counts as an unknown piece, equally likely in every language, so it decides nothing. A run of
letters is cut into parts of `LONGEST_RUN` characters, all of which count, so that the sums of a text
without spaces need the memory of one part.

Learning takes the languages from all labelled rows that have a letter, and the texts of a bounded sample
of them (`most_documents`, by a hash of the id within each language: all rows of a language below its
bound); their words are counted by language in Spark and the expectations are summed by piece, at most
one row for each piece and language. Scoring reads every whole text; a batch's distinct words are
scored once.

Defined cases: `und` with score 0 when the text is null or has no letter, or when nothing could be
learned; null ids and repeated ids are kept as rows; null languages are not learned from; ties go to
the first language by name; other columns are ignored by `identify` and kept by `reject_unknown`, which
drops the rows of null texts and texts without a letter and no others, also when nothing could be learned.
An empty table gives no rows.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.encoding import slices
from larder.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "und"
UNKNOWN_PIECE = 1e-7
BEGIN = "▁"  # the vocabulary's mark of a word's beginning
# Letters are the categories L of Unicode; the numeric signs that a word pattern also takes are left out by rule.
NUMERIC = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
LETTERS = re.compile(f"[^\\W\\d_{re.escape(NUMERIC)}]+")
LONGEST_RUN = 512  # characters of one lattice, with the mark
OUT = "doc_id long, lang_pred string, score double"
SLICE_BYTES = 2 << 20  # of texts that are split into words at once


@dataclass(frozen=True)
class Training:
    most_documents: int = 20_000
    rounds: int = 2
    smoothing: float = 0.02


def pieces_of(vocabulary: str) -> list[str]:
    """All lettered pieces of a SentencePiece model, without control and byte pieces, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    return [p for p in names if LETTERS.fullmatch(p.replace(BEGIN, "", 1) or "a")]


def units(raw: str) -> list[str]:
    """Lower-cased runs of letters of a word, each with the mark of a beginning; long runs in parts."""
    marked = [BEGIN + x for x in LETTERS.findall(raw.lower())]
    return [x[i : i + LONGEST_RUN] for x in marked for i in range(0, len(x), LONGEST_RUN)]


class Lattice:
    """Forward and backward sums for words of one length at a time; probability has a row for each piece.

    Pieces are found by walking a tree of their characters for all the words at once.
    """

    def __init__(self, pieces: Sequence[str], probability: np.ndarray, longest: int):
        self.longest, self.none, self.unknown = longest, len(pieces), len(pieces) + 1
        self.single = np.full(sys.maxunicode + 1, self.unknown, dtype=np.int32)  # pieces of one character
        self.class_of = np.zeros(sys.maxunicode + 1, dtype=np.int32)  # 0: in no longer piece
        for k, piece in enumerate(pieces):
            if len(piece) == 1:
                self.single[ord(piece)] = k
        for k, c in enumerate(sorted({c for p in pieces if len(p) > 1 for c in p}), 1):
            self.class_of[ord(c)] = k
        self.width = int(self.class_of.max()) + 1
        steps: dict[tuple[int, int], int] = {}
        ends = {}
        for k, piece in enumerate(pieces):
            node = 1
            for c in self.class_of[[ord(c) for c in piece]].tolist() if len(piece) > 1 else ():
                node = steps.setdefault((node, c), len(steps) + 2)
            if node > 1:
                ends[node] = k
        # Node 0 is where no piece goes on, node 1 the root. Only nodes that go on have a row of next steps.
        row = {node: r for r, node in enumerate(dict.fromkeys(n for n, _ in steps), 1)}
        self.row = np.zeros(len(steps) + 2, dtype=np.int64)
        self.row[list(row)] = list(row.values())
        self.next = np.zeros((len(row) + 1) * self.width, dtype=np.int32)
        if steps:
            self.next[[row[node] * self.width + c for node, c in steps]] = list(steps.values())
        self.piece = np.full(len(steps) + 2, self.none)
        if ends:
            self.piece[list(ends)] = list(ends.values())
        # Two further rows: no such piece, and an unknown character.
        languages = probability.shape[1]
        self.table = np.vstack([probability, np.zeros((1, languages)), np.full((1, languages), UNKNOWN_PIECE)])

    def _pieces(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """For each part (i, j) of the words that some word has as a piece, the piece of each word."""
        n = len(words[0])
        points = np.array(words, dtype=f"<U{n}").view(np.uint32).reshape(len(words), n)
        classes = self.class_of[points]
        found = {}
        for i in range(n):
            node = np.ones(len(words), dtype=np.int32)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                node = self.next[self.row[node] * self.width + classes[:, j - 1]]
                found[i, j] = self.single[points[:, i]] if j == i + 1 else self.piece[node]
                if not node.any():
                    break
        return found

    def forward(self, words: list[str], keep: bool = False):
        """Log probability (words x languages); with keep also the sums and the pieces that were found.

        Each position's sums are divided by their largest, so long words do not vanish.
        """
        n = len(words[0])
        alpha = [np.ones((len(words), self.table.shape[1]))]
        scale = [np.zeros(len(words))]
        found = self._pieces(words)
        for j in range(1, n + 1):
            total = np.zeros_like(alpha[0])
            for i in range(max(0, j - self.longest), j):
                if (i, j) in found:
                    total += alpha[i] * self.table[found[i, j]] * np.exp(scale[i] - scale[j - 1])[:, None]
            most = total.max(axis=1)
            alpha.append(total / most[:, None])
            scale.append(scale[j - 1] + np.log(most))
        with np.errstate(divide="ignore"):
            logs = np.log(alpha[n]) + scale[n][:, None]
        return (logs, alpha, scale, found) if keep else logs

    def expected(self, words: list[str], weights: np.ndarray, out: np.ndarray) -> None:
        """Add each piece's expected uses, by language; weights: uses of each word in each language."""
        logs, alpha, scale, found = self.forward(words, keep=True)
        n = len(words[0])
        beta = [None] * n + [np.ones_like(alpha[0])]  # scaled as alpha is: beta[j] * alpha[j] / end
        for j in range(n - 1, -1, -1):
            beta[j] = sum(self.table[found[j, k]] * beta[k] * np.exp(scale[j] - scale[k])[:, None]
                          for k in range(j + 1, min(n, j + self.longest) + 1) if (j, k) in found)
        share = weights / np.maximum(alpha[n], 1e-300)
        for (i, j), at in found.items():
            use = alpha[i] * self.table[at] * beta[j] * np.exp(scale[i] - scale[j])[:, None] * share
            used = use.sum(axis=1) > 0
            np.add.at(out, at[used], use[used])


def by_length(words: Sequence[str], most: int = 1 << 16) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Words in groups of one length and of about so many characters, with their places."""
    groups = defaultdict(list)
    for k, w in enumerate(words):
        groups[len(w)].append(k)
    for length, places in groups.items():
        step = most // max(length, 1) + 1
        for i in range(0, len(places), step):
            part = places[i : i + step]
            yield np.array(part), [words[k] for k in part]


def log_probabilities(lattice: Lattice, words: Sequence[str]) -> np.ndarray:
    out = np.zeros((len(words), lattice.table.shape[1]))
    for places, group in by_length(words):
        out[places] = lattice.forward(group)
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    pieces: list[str]
    probability: np.ndarray  # pieces x languages
    longest: int

    def parts(self) -> tuple:
        return self.languages, self.pieces, self.probability, self.longest


def shares(sizes: dict[str, int], most: int) -> dict[str, float]:
    """The share of rows to learn from of each language: all rows of a language below its bound.

    The bound is the same for all languages, and as high as a sum of `most` allows.
    """
    left, bound = most, 0
    rising = sorted(sizes.values())
    for k, n in enumerate(rising):
        bound = max(1, left // (len(rising) - k))
        left -= min(n, bound)
        if n > bound:
            break
    else:
        return dict.fromkeys(sizes, 1.0)
    return {lang: min(1.0, bound / n) for lang, n in sizes.items()}


def _sample(df: DataFrame, most: int) -> tuple[list[str], DataFrame]:
    """All languages of the rows, and rows of each chosen by a hash of their id, at least that of the smallest hash."""
    hashed = df.withColumn("hashed", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    seen = hashed.groupBy("lang").agg(F.count("*").alias("n"), F.min("hashed").alias("least")).collect()
    part = shares({r["lang"]: r["n"] for r in seen}, most)
    languages = sorted(part)
    if all(x == 1.0 for x in part.values()):
        return languages, df
    limits = [(r["lang"], max(int(part[r["lang"]] * (1 << 30)), r["least"] + 1)) for r in seen]
    below = df.sparkSession.createDataFrame(limits, "lang string, below long")  # one row for each language
    chosen = hashed.join(F.broadcast(below), "lang").where(F.col("hashed") < F.col("below"))
    return languages, chosen.drop("hashed", "below")


def _word_counts(df: DataFrame) -> DataFrame:
    """lang, word, n: partial counts in each task, then one sum."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted: dict[str, Counter] = defaultdict(Counter)
            for a, b in slices(batch["text"], SLICE_BYTES):
                words = pc.ascii_split_whitespace(pc.fill_null(batch["text"][a:b], ""))
                coded = words.flatten().dictionary_encode()
                langs, codes = batch["lang"][a:b].to_numpy(zero_copy_only=False), coded.indices.to_numpy()
                owner = np.repeat(langs, np.diff(words.offsets.to_numpy()))
                known = [units(w) for w in coded.dictionary.to_pylist()]
                for lang in np.unique(langs):
                    n = np.bincount(codes[owner == lang], minlength=len(known))
                    for k in np.flatnonzero(n).tolist():
                        for unit in known[k]:
                            counted[lang][unit] += int(n[k])
            rows = [(lang, w, n) for lang, c in counted.items() for w, n in c.items()]
            lang, word, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    found = df.mapInArrow(count, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _round(counts: DataFrame, model: Model) -> np.ndarray:
    """Expected uses of each piece in each language."""
    sent = counts.sparkSession.sparkContext.broadcast(model.parts())  # one number for each piece and language

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        lattice = Lattice(model.pieces, model.probability, model.longest)
        out = np.zeros(lattice.table.shape)
        column = {lang: k for k, lang in enumerate(model.languages)}
        for batch in batches:
            words = batch["word"].to_pylist()
            weights = np.zeros((len(words), len(column)))
            weights[np.arange(len(words)), [column[x] for x in batch["lang"].to_pylist()]] = batch["n"].to_numpy()
            for places, group in by_length(words):
                lattice.expected(group, weights[places], out)
        piece, lang = np.nonzero(out[: len(model.pieces)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(out[piece, lang])], ["piece", "lang", "uses"])

    uses = counts.mapInArrow(expect, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
    total = np.zeros(model.probability.shape)
    rows = uses.toPandas()  # at most pieces x languages
    total[rows["piece"], rows["lang"]] = rows["uses"]
    return total


def learn(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          training: Training = Training()) -> Model:
    """From all rows given whose text and language are known; rows to hold out are left out by the caller."""
    known = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    # A text without a letter teaches nothing.
    languages, sample = _sample(known.where(F.col("text").rlike(r"\p{L}")), training.most_documents)
    counts = durable(_word_counts(sample.select("text", "lang")), "word_counts")
    pieces = pieces_of(vocabulary)
    longest = max(map(len, pieces))
    model = Model(languages, pieces, np.full((len(pieces), len(languages)), 1 / len(pieces)), longest)
    for _ in range(training.rounds if languages else 0):
        uses = _round(counts, model) + training.smoothing
        model = Model(languages, pieces, uses / uses.sum(axis=0), longest)
    return model


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the language's share of the text's probability) of each row."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not model.languages:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = df.sparkSession.sparkContext.broadcast(model.parts())  # one number for each piece and language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        scorer = _Scorer(model)
        for batch in batches:
            for a, b in slices(batch["text"], SLICE_BYTES):
                lang, score = scorer.score(batch["text"][a:b])
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], lang, score], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, OUT)


class _Scorer:
    """Scores texts; a task remembers words up to a fixed size, then only those of its present slice."""

    def __init__(self, model: Model, most_characters: int = 6_000_000):
        self.languages, self.most_characters = model.languages, most_characters
        self.lattice = Lattice(model.pieces, model.probability, model.longest)
        self.place: dict[str, int] = {}
        self.size = 0
        self.logs, self.lettered = np.zeros((0, len(model.languages))), np.zeros(0, dtype=bool)

    def _places(self, words: list[str]) -> np.ndarray:
        """Rows of `logs` and `lettered` for different words."""
        new = [w for w in words if w not in self.place]
        size = sum(map(len, new)) + 16 * len(new)  # a word takes more than its characters
        if self.place and self.size + size > self.most_characters:
            known = [w for w in words if w in self.place]
            rows = np.array([self.place[w] for w in known], dtype=np.int64)
            self.logs, self.lettered = self.logs[rows], self.lettered[rows]
            self.place = dict(zip(known, range(len(known))))
            self.size = sum(map(len, known)) + 16 * len(known)
        if new:
            logs, lettered = self._measure(new)
            self.place.update(zip(new, range(len(self.logs), len(self.logs) + len(new))))
            self.logs, self.lettered = np.vstack([self.logs, logs]), np.concatenate([self.lettered, lettered])
            self.size += size
        return np.fromiter((self.place[w] for w in words), dtype=np.int64, count=len(words))

    def _measure(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of words by language, and whether they have a letter."""
        parts = [units(w) for w in words]
        at = {u: k for k, u in enumerate(dict.fromkeys(u for p in parts for u in p))}
        rows = np.array([at[u] for p in parts for u in p], dtype=np.int64)
        counts = np.array([len(p) for p in parts])
        found, owner = log_probabilities(self.lattice, list(at))[rows], np.repeat(np.arange(len(words)), counts)
        return np.stack([np.bincount(owner, x, len(words)) for x in found.T], axis=1), counts > 0

    def score(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        codes = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        owner = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
        total = np.stack([np.bincount(owner, x[codes], len(texts)) for x in self.logs.T], axis=1)
        letters = np.bincount(owner, self.lettered[codes], len(texts)) > 0
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        names = np.array([*self.languages, UNKNOWN], dtype=object)
        return (pa.array(names[np.where(letters, best, len(names) - 1)], pa.string()),
                pa.array(np.where(letters, share, 0.0)))


def held_out(id_col: str = "doc_id", every: int = 5) -> Column:
    """The rows that are never learned from: crc32 of the id as text, modulo `every`, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0, F.lit(True))


def _lettered_rows(place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [LETTERS.search(t.as_py() or "") is not None for t in batch.column(place)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return run


def reject_unknown(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text has a letter, with all columns; one pass without a copy or a join.

    What the model has learned rejects nothing else: every text with a letter gets a language. Without
    a learned language the same rows stay.
    """
    place = df.columns.index(text_col)
    if not model.languages:
        return df.mapInArrow(_lettered_rows(place), df.schema)
    sent = df.sparkSession.sparkContext.broadcast(model.parts())  # one number for each piece and language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(Model(*sent.value))
        for batch in batches:
            texts = batch.column(place)
            for a, b in slices(texts, SLICE_BYTES):
                lang, _ = scorer.score(texts[a:b])
                yield batch.slice(a, b - a).filter(pc.not_equal(lang, UNKNOWN))

    return df.mapInArrow(run, df.schema)
