"""What a task holds at once."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from larder.llm import pseudonyms
from larder.llm.encoding import PiecewiseEncoder, laid_out, ragged, vocabulary_text


def test_laid_out_equals_ragged():
    pool, starts, lengths = np.arange(50, dtype=np.uint16), np.array([0, 7, 20]), np.array([3, 0, 9])
    for codes in (np.zeros(0, dtype=np.int32), np.array([2, 1, 0, 0, 2], dtype=np.int32), np.ones(9, dtype=np.int32)):
        found = laid_out(pool, starts, lengths, codes, at_once=2)
        assert found.dtype == pool.dtype and found.tolist() == ragged(pool, starts[codes], lengths[codes]).tolist()


def test_encoding_holds_few_bytes_an_id():
    encoder = PiecewiseEncoder(vocabulary_text(public_tokenizers.path("word_bpe_49k.json")))
    texts = pa.array([" ".join(f"unremarkable{k % 977}." for k in range(20_000))] * 20)
    encoder.encode(texts)  # the words are known from here on
    tracemalloc.start()
    found = encoder.encode(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found.ids) > 1_000_000 and most < 20 * len(found.ids)


def test_pseudonyms_come_in_slices(make, monkeypatch):
    taken = {}
    frame = make([(1, "x")])
    monkeypatch.setattr(type(frame), "mapInArrow", lambda df, run, schema: taken.setdefault("run", run) and df.withColumn(
        schema.names[-1], df["text"]))
    pseudonyms.pseudonymise(frame, "k")
    texts = [f"{'plain words ' * 40_000}{k} mail jane.roe{k}@example.org" for k in range(12)] + [None, ""]
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(14)), "text": pa.array(texts, pa.string()), "lang": ["en"] * 14,
                                       "row": ["n"] * 14, "tie": pa.array([0] * 14, pa.int32())})
    found = list(taken["run"](iter([rows, rows.slice(0, 0)])))
    assert max(b.nbytes for b in found) < 4 << 20 and [x for b in found for x in b["doc_id"].to_pylist()] == list(range(14))
    plain = pseudonyms.Pseudonyms(b"k")
    assert [t for b in found for t in b["text"].to_pylist()] == [t if t is None else plain.replace(t)[0] for t in texts]
