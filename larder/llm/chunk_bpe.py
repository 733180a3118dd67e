"""Encoding with reuse of content-defined chunks, and decoding (operator 10).

A rolling hash over the bytes cuts each text at places that depend on the nearby bytes only, so
that copies and shared passages are cut alike wherever they stand. Distinct chunks are encoded once
for all documents of a task. A cut can fall inside a word; there the ids of the two chunks are not
those of the text. Such a join is repaired: the part of either chunk that the other can influence,
back and forth to the nearest white space, is taken off both and encoded again as one piece.
Beyond white space the vocabulary's splitting rule lets nothing influence the ids, so the result
agrees exactly with encoding the text at once; if a chunk has no white space, the piece grows over
its neighbours until it meets some.

Chunks are shared within a task and not across the cluster: to bring them together would move the
corpus twice (chunks out, ids back), which costs more than encoding a chunk again.

Defined cases: a null text is empty and gives no ids and an empty text; ids may be null or repeat,
and each row stays one row; other columns are ignored; an empty table gives no rows. Memory: a
slice of texts and the remembered chunks, which are dropped at `most_bytes`.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.encoding import PiecewiseEncoder, offsets_of, ragged, slices, vocabulary_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 32  # bytes that a cut depends on
MEAN_CHUNK = 512  # bytes, a power of two
OUT = "doc_id long, ids array<int>, decoded string"


def gear(seed: int = 7) -> np.ndarray:
    """A random 32-bit number for each byte value."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """At each byte the sum of the table's numbers of the last WINDOW bytes, each doubled once per byte since."""
    h, span = table[data], 1
    while span < WINDOW:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))  # the right side is made before it is stored
        span *= 2
    return h


def pieces(data: np.ndarray, bounds: np.ndarray, table: np.ndarray, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Starts of chunks and join pieces; each text's start is among them.

    data: the bytes of the texts in a row, bounds: where texts begin, and the end.
    """
    high = np.uint32((mean - 1) << (32 - mean.bit_length() + 1))
    cuts = np.flatnonzero(rolling_hash(data, table) & high == 0) + 1
    text = np.searchsorted(bounds, cuts, side="right") - 1
    inside = (cuts < len(data)) & (cuts - bounds[text] >= WINDOW)
    cuts, text = cuts[inside], text[inside]
    spaces = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
    after = np.searchsorted(spaces, cuts)  # the first white space at or after the cut
    padded = np.concatenate([[-1], spaces, [len(data)]])
    left = np.maximum(padded[after] + 1, bounds[text])
    right = np.minimum(padded[after + 1], bounds[text + 1])
    return np.unique(np.concatenate([bounds[:-1], left, right[right < len(data)]]))


class ChunkEncoder:
    """Encodes texts by their chunks; what it knows of chunks lasts until most_bytes of them are held."""

    def __init__(self, vocabulary: str, mean: int = MEAN_CHUNK, most_bytes: int = 128 << 20):
        self.words = PiecewiseEncoder(vocabulary)
        self.mean, self.most_bytes, self.table = mean, most_bytes, gear()
        self.chunks = self.encoded = 0
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.bytes = 0
        self.pool = np.zeros(0, dtype=self.words.kind)
        self.starts, self.lengths = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin."""
        texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
        bounds = offsets_of(pc.binary_length(texts).to_numpy())
        if bounds[-1] == 0:
            return self.pool[:0], np.zeros(len(texts) + 1, dtype=np.int64)
        first = int(np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + 1)[-1])
        store = texts.buffers()[2].slice(first, int(bounds[-1]))
        starts = pieces(np.frombuffer(store, dtype=np.uint8), bounds, self.table, self.mean)
        edges = np.append(starts, bounds[-1])
        parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), store).dictionary_encode()
        which = self._slots(parts.dictionary)[parts.indices.to_numpy()]
        counts = self.lengths[which]
        after = offsets_of(counts)
        self.chunks += len(starts)
        return ragged(self.pool, self.starts[which], counts), after[np.searchsorted(edges, bounds)]

    def _slots(self, chunks: pa.Array) -> np.ndarray:
        names = chunks.to_pylist()
        size = chunks.nbytes
        if self.bytes + size > self.most_bytes:
            self._forget()
        new = [x for x in names if x not in self.slot]
        if new:
            found = self.words.encode(pa.array(new))
            self.slot.update(zip(new, range(len(self.starts), len(self.starts) + len(new))))
            self.starts = np.concatenate([self.starts, len(self.pool) + found.offsets[:-1]])
            self.lengths = np.concatenate([self.lengths, np.diff(found.offsets)])
            self.pool = np.concatenate([self.pool, found.ids])
            self.bytes += size
            self.encoded += len(new)
        return np.fromiter((self.slot[x] for x in names), dtype=np.int64, count=len(names))


class Decoder:
    """The library's decode without skipping special tokens."""

    def __init__(self, words: PiecewiseEncoder):
        self.library = words.library
        self.joins = self.library.decoder is None  # then the tokens' names are joined by spaces
        self.names = pa.array([self.library.id_to_token(i) for i in range(words.size)], pa.string())

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        if not self.joins:
            return pa.array(self.library.decode_batch(
                [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])], skip_special_tokens=False), pa.string())
        names = self.names.take(pa.array(ids))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names), " ")


def encode_and_decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                      mean: int = MEAN_CHUNK) -> DataFrame:
    """One row per document: doc_id, ids, decoded."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary))  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            if encoder is None:
                encoder = ChunkEncoder(sent.value, mean)
                decoder = Decoder(encoder.words)
            for a, b in slices(batch["text"], 4 << 20):
                ids, offsets = encoder.encode(batch["text"][a:b])
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][a:b], listed, decoder.decode(ids, offsets)], ["doc_id", "ids", "decoded"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, OUT)
