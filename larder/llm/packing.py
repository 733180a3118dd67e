"""Order-preserving packing by dynamic programming (operator 6).

Documents in ascending order, each followed by an end id, form a stream that is cut into sequences
of at most `capacity` ids. Cuts may fall at the end of a document (free), at the end of a sentence
(`sentence_penalty`), or inside a long sentence on a grid of `grid` ids (`inner_penalty`). A sequence
costs its padding, which is `capacity - length`, or nothing when the length is a power of two. The
cheapest cuts are found by

    best[j] = penalty[j] + min over i of best[i] + padding(p[j] - p[i])

For lengths that are padded the minimum of best[i] + p[i] over the last `capacity` ids is kept in a
monotone queue; for powers of two the one fitting i is looked up.

Each task packs its own range of documents in blocks of at least `block` ids, about 4 MB of text: the last few sequences of a
block are opened again together with the next one. Of sentence ends closer than `closest` ids only one is a
place to cut, and ends of documents all are: the cuts are the cheapest over these places. Defined cases: a null text is empty and consists
of the end id; null ids come first; equal ids are separate documents; a document longer than the
capacity runs over several sequences; an empty table packs to no rows; other columns are ignored.
Memory: one block, or one document if that is longer.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame

from larder.llm.encoding import PiecewiseEncoder, give_back, slices, vocabulary_text, with_end
from larder.llm.token_files import in_order

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
          "offset long, padded_length long")
REOPENED = 4  # sequences at the end of a block that the next block may cut anew


@dataclass(frozen=True)
class Costs:
    capacity: int = 4096
    sentence_penalty: int = 24
    inner_penalty: int = 160
    grid: int = 64
    closest: int = 16  # of the places in a cell of so many ids the first is used, and all ends of documents
    block: int = 1 << 18
    least_power: int = 64  # shorter powers of two are not aimed at


def cut_places(ends: np.ndarray, sentences: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which the stream may be cut, and their penalties; the last is the stream's end."""
    marks = np.union1d(ends, sentences)
    gaps = np.diff(marks, prepend=0)
    long = np.flatnonzero(gaps > 4 * costs.grid)
    inner = [np.arange(marks[i] - gaps[i] + costs.grid, marks[i], costs.grid) for i in long]
    places = np.union1d(marks, np.concatenate([[], *inner]).astype(np.int64))
    penalty = np.full(len(places), costs.inner_penalty, dtype=np.int64)
    penalty[np.searchsorted(places, sentences)] = costs.sentence_penalty
    penalty[np.searchsorted(places, ends)] = 0
    keep = (np.diff(places // costs.closest, prepend=-1) > 0) | (penalty == 0)  # the first of each cell
    return places[keep], penalty[keep]


def padding(length: int, capacity: int) -> int:
    return 0 if length & (length - 1) == 0 else capacity - length


def best_cuts(places: np.ndarray, penalty: np.ndarray, costs: Costs) -> list[int]:
    """Ends of the cheapest sequences over the whole stream."""
    starts = np.concatenate([[0], places])
    at, extra = starts.tolist(), [0, *penalty.tolist()]
    powers = [1 << k for k in range(costs.capacity.bit_length()) if costs.least_power <= 1 << k <= costs.capacity]
    # For each place the places that lie a power of two before it; few places have one.
    exact: dict[int, list[int]] = {}
    for length in powers:
        found = np.searchsorted(starts, starts - length)
        hits = np.flatnonzero((starts >= length) & (starts[np.minimum(found, len(starts) - 1)] == starts - length))
        for j, i in zip(hits.tolist(), found[hits].tolist()):
            exact.setdefault(j, []).append(i)
    best, back = [0] * len(at), [0] * len(at)
    queue = deque([(0, 0)])  # (best[i] + at[i], i), rising
    for j in range(1, len(at)):
        end = at[j]
        while at[queue[0][1]] < end - costs.capacity:
            queue.popleft()
        cost, source = queue[0][0] + costs.capacity - end, queue[0][1]
        if (end - at[source]).bit_count() == 1:
            cost = best[source]
        for i in exact.get(j, ()):
            if best[i] < cost:
                cost, source = best[i], i
        best[j], back[j] = cost + extra[j], source
        key = best[j] + end
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Documents in, pieces out; what is not fully packed waits for the next block."""

    def __init__(self, costs: Costs, first_sequence: int, ids_type: type):
        self.costs, self.sequence = costs, first_sequence
        self.ids = np.zeros(0, dtype=ids_type)
        self.sentences = np.zeros(0, dtype=np.int64)
        self.names: list = []
        self.packed = np.zeros(0, dtype=np.int64)  # of each document the ids that are in earlier sequences
        self.sizes = np.zeros(0, dtype=np.int64)
        self.ends = np.zeros(0, dtype=np.int64)  # where each document ends in ids

    def add(self, names: list, found) -> None:
        begin = len(self.ids)
        self.ids = np.concatenate([self.ids, found.ids])
        self.sentences = np.concatenate([self.sentences, found.sentence_ends + begin])
        self.names += names
        self.packed = np.concatenate([self.packed, np.zeros(len(names), dtype=np.int64)])
        self.sizes = np.concatenate([self.sizes, np.diff(found.offsets)])
        self.ends = np.concatenate([self.ends, found.offsets[1:] + begin])

    def pack(self, last: bool) -> pa.RecordBatch | None:
        """Pieces of the sequences that are settled: all of them if `last`."""
        if not self.names:
            return None
        cuts = np.array(best_cuts(*cut_places(self.ends, self.sentences, self.costs), self.costs), dtype=np.int64)
        if not last:
            cuts = cuts[:-REOPENED]
        if not len(cuts):
            return None
        done = int(cuts[-1])
        stops = np.union1d(self.ends[self.ends <= done], cuts)  # a piece ends with its document or its sequence
        starts = np.concatenate([[0], stops[:-1]])
        document = np.searchsorted(self.ends, starts, side="right")
        sequence = np.searchsorted(cuts, starts, side="right")
        begins = np.concatenate([[0], cuts])[sequence]
        lengths = np.diff(np.concatenate([[0], cuts]))
        whole = np.where((lengths & (lengths - 1)) == 0, lengths, self.costs.capacity)[sequence]
        first = self.ends - self.sizes + self.packed  # where a document's waiting ids begin
        data = pa.py_buffer(self.ids[:done].astype("<u4").tobytes())
        offsets = pa.py_buffer((4 * np.concatenate([[0], stops])).astype("<i4").tobytes())
        columns = {
            "doc_id": pa.array([self.names[d] for d in document.tolist()], pa.int64()),
            "start": pa.array(self.packed[document] + starts - first[document]),
            "length": pa.array(stops - starts),
            "ids": pa.Array.from_buffers(pa.binary(), len(stops), [None, offsets, data]),
            "doc_tokens": pa.array(self.sizes[document]),
            "sequence_id": pa.array(self.sequence + sequence),
            "offset": pa.array(starts - begins),
            "padded_length": pa.array(whole),
        }
        self.sequence += len(cuts)
        left = int(np.searchsorted(self.ends, done, side="right"))
        self.packed[left:] += np.maximum(done - first[left:], 0)
        self.ids = self.ids[done:].copy()
        self.sentences = self.sentences[self.sentences > done] - done
        self.names, self.packed, self.sizes = self.names[left:], self.packed[left:], self.sizes[left:]
        self.ends = self.ends[left:] - done
        return pa.RecordBatch.from_pydict(columns)


def pack(df: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
         costs: Costs = Costs()) -> DataFrame:
    """One row per piece of a document in a sequence, with its ids (little-endian unsigned 32-bit).

    sequence_id rises with the documents; the ids of a task's sequences begin at its number times 2**32.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary))  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        give_back()  # what earlier stages have left
        for batch in batches:
            if not batch.num_rows:
                continue
            if packer is None:
                encoder = PiecewiseEncoder(sent.value)
                packer = Packer(costs, TaskContext.get().partitionId() << 32, encoder.kind)
            for a, b in slices(batch["text"], 4 << 20):
                packer.add(batch["doc_id"][a:b].to_pylist(), with_end(encoder.encode(batch["text"][a:b]), end_id))
                if len(packer.ids) >= costs.block:
                    found = packer.pack(last=False)
                    if found is not None:
                        yield found
                    found = None
                    give_back()
        found = packer.pack(last=True) if packer else None
        if found is not None:
            yield found
        found = packer = encoder = None
        give_back()

    return in_order(df, id_col, text_col).mapInArrow(run, PIECES)
