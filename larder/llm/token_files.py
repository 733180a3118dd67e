"""Token ids as Arrow files of equal-length sequences (operator 1).

`write_token_files` encodes whole texts, adds an end id to each, and writes the ids in ascending
order of the documents. Each task owns a range of documents and writes two Arrow IPC files:

* part-N.tokens.arrow: batches of `tokens` (fixed-size list of unsigned integers) and `mask`
  (fixed-size list of booleans, false where the last sequence is filled up);
* part-N.docs.arrow: doc_id, start (ids before it in this part), n_tokens.

The files are uncompressed, so sequence i of a mapped file is a view of its bytes
(`TokenPart.sequence`). The table `manifest` in the same folder holds a row for each part. A file is
written under the attempt's own name and then renamed; a repeated task writes the same bytes again.

Defined cases: a null text is empty and gives the end id alone; null ids come first; rows with the
same id are separate documents, ordered by a hash of the text; an empty table gives a folder whose
manifest has no rows; further columns are ignored. Memory: a slice of texts and one batch of
sequences for each task, whatever the length of the table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.encoding import PiecewiseEncoder, slices, vocabulary_text, with_end

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEQUENCE_LENGTH = 2048
SEQUENCES_A_BATCH = 256
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part int, path string, docs long, tokens long, sequences long"
READ = "doc_id long, start long, n_tokens long, ids binary"


def in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents by ascending id, dealt out in ranges; rows of one id are split by their text's hash."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = rows.withColumn("tie", F.xxhash64("text"))
    return keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")


def sequence_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class _SequenceWriter:
    """Cuts a stream of ids into sequences and writes them in batches."""

    def __init__(self, sink, length: int, kind: type):
        self.length, self.kind = length, kind
        self.schema = sequence_schema(length, pa.from_numpy_dtype(kind))
        self.file = pa.ipc.new_file(sink, self.schema)
        self.waiting = np.zeros(0, dtype=kind)
        self.sequences = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting = np.concatenate([self.waiting, ids])
        step = self.length * SEQUENCES_A_BATCH
        full = len(self.waiting) // step * step
        for i in range(0, full, step):
            self._write(self.waiting[i : i + step], step)
        self.waiting = self.waiting[full:].copy()

    def _write(self, ids: np.ndarray, known: int) -> None:
        rows = len(ids) // self.length
        tokens = pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < known), self.length)
        self.file.write_batch(pa.record_batch([tokens, mask], schema=self.schema))
        self.sequences += rows

    def close(self) -> None:
        known = len(self.waiting)
        if known:
            self._write(np.pad(self.waiting, (0, -known % self.length)), known)
        self.file.close()


def write_token_files(df: DataFrame, folder: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id",
                      text_col: str = "text", length: int = SEQUENCE_LENGTH) -> DataFrame:
    """Write the files into a new folder that all executors reach; returns its manifest."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary_text(vocabulary))  # one vocabulary file

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        files = None
        docs = tokens = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                encoder = PiecewiseEncoder(sent.value)
                system, base = pa.fs.FileSystem.from_uri(folder)
                system.create_dir(base, recursive=True)
                names = [f"{base}/part-{part:06d}.{x}.arrow" for x in ("tokens", "docs")]
                files = [system.open_output_stream(f"{n}.attempt-{attempt}") for n in names]
                writer, index = _SequenceWriter(files[0], length, encoder.kind), pa.ipc.new_file(files[1], DOCS)
            for a, b in slices(batch["text"]):
                found = with_end(encoder.encode(batch["text"][a:b]), end_id)
                counts = np.diff(found.offsets)
                starts = pa.array(tokens + found.offsets[:-1])
                index.write_batch(pa.record_batch([batch["doc_id"][a:b], starts, pa.array(counts)], schema=DOCS))
                writer.add(found.ids)
                docs, tokens = docs + len(counts), tokens + len(found.ids)
        if files is None:
            return
        writer.close()
        index.close()
        for file, name in zip(files, names):
            file.close()
            system.move(f"{name}.attempt-{attempt}", name)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "path": [f"{folder}/part-{part:06d}"], "docs": [docs],
            "tokens": [tokens], "sequences": [writer.sequences]})

    in_order(df, id_col, text_col).mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


@dataclass
class TokenPart:
    """Random access to the sequences of one part; `mapped` is a memory map or an open file."""

    file: pa.ipc.RecordBatchFileReader
    docs: pa.Table

    @classmethod
    def open(cls, path: str) -> TokenPart:
        system, base = pa.fs.FileSystem.from_uri(path)
        local = isinstance(system, pa.fs.LocalFileSystem)

        def source(name):
            return pa.memory_map(name) if local else system.open_input_file(name)

        return cls(pa.ipc.open_file(source(f"{base}.tokens.arrow")),
                   pa.ipc.open_file(source(f"{base}.docs.arrow")).read_all())

    def batch(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and mask of the i-th batch; the tokens are views of the file's bytes."""
        found = self.file.get_batch(i)
        shape = (found.num_rows, self.file.schema.field("tokens").type.list_size)
        mask = found["mask"].flatten().to_numpy(zero_copy_only=False)
        return found["tokens"].flatten().to_numpy().reshape(shape), mask.reshape(shape)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        tokens, mask = self.batch(i // SEQUENCES_A_BATCH)
        return tokens[i % SEQUENCES_A_BATCH], mask[i % SEQUENCES_A_BATCH]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row of docs, start, ids) of each document, read batch by batch."""
        held, begin, batch = np.zeros(0, dtype=np.uint32), 0, 0
        starts, counts = (self.docs[c].to_numpy() for c in ("start", "n_tokens"))
        for row, (start, n) in enumerate(zip(starts.tolist(), counts.tolist())):
            if start + n > begin + len(held):
                more = [held[start - begin :]]
                have = len(more[0])
                while have < n:
                    tokens, mask = self.batch(batch)
                    more.append(tokens[mask])
                    have, batch = have + len(more[-1]), batch + 1
                held, begin = np.concatenate(more).astype("<u4"), start
            yield row, start, held[start - begin : start - begin + n]


def read_token_files(spark: SparkSession, folder: str, id_bytes_a_batch: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # One row per part, so this window holds as many rows as there are files.
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("part", "path", F.coalesce(before, F.lit(0)).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, tokens_before in zip(batch["path"].to_pylist(), batch["before"].to_pylist()):
                part = TokenPart.open(path)
                rows, starts, ids, held = [], [], [], 0

                def out():
                    names = pa.array(rows, pa.int64())
                    return pa.RecordBatch.from_pydict({
                        "doc_id": pc.take(part.docs["doc_id"], names).combine_chunks(),
                        "start": pa.array(starts, pa.int64()),
                        "n_tokens": pc.take(part.docs["n_tokens"], names).combine_chunks(),
                        "ids": pa.array(ids, pa.binary())})

                for row, start, found in part.documents():
                    rows.append(row), starts.append(tokens_before + start), ids.append(found.tobytes())
                    held += len(ids[-1])
                    if held > id_bytes_a_batch:
                        yield out()
                        rows, starts, ids, held = [], [], [], 0
                if rows:
                    yield out()

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "part").mapInArrow(read, READ)
