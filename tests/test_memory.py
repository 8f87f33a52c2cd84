"""What tasks hold at once: bytes a token of a shard, cells of distances, pieces of texts."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quillspark.operators import blocks, search, segment


def test_a_shard_holds_few_bytes_a_token():
    r = np.random.default_rng(1)
    n = 400_000
    tokens, lengths = pa.array([f"w{x}" for x in r.integers(0, 30_000, n)]), np.full(n // 100, 100)
    tracemalloc.start()
    for _ in blocks.shard_rows("s", pa.array(np.arange(n // 100)), tokens, lengths, lengths, lambda tf, size: tf / (tf + size)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * n, peak / n


def test_gathered_batches_are_let_go():
    before, held = pa.total_allocated_bytes(), blocks.Counted()
    for k in range(4):
        words = pa.array(["word"] * 2_000_000)
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(k * 20_000, (k + 1) * 20_000)), pa.ListArray.from_arrays(pa.array(np.arange(0, 2_000_001, 100), pa.int32()), words)], names=["key", "words"])
        for at in range(0, 20_000, 500):
            part = batch.slice(at, 500)
            held.add(part.column(0), part.column(1).flatten(), np.full(500, 100), np.full(500, 100))
        del words, batch, part
    assert pa.total_allocated_bytes() - before < 5_000_000
    assert held.n_tokens == 8_000_000


def test_distances_are_made_in_tiles(spark, monkeypatch):
    r, run = np.random.default_rng(2), []
    v = spark.createDataFrame([(i, [float(x) for x in r.normal(size=4)]) for i in range(1000)], "vec_id long, embedding array<float>")
    real = type(v).mapInArrow
    monkeypatch.setattr(type(v), "mapInArrow", lambda self, f, schema: run.append(f) or real(self, f, schema))
    got = search.nearest(v.withColumnRenamed("vec_id", "query_id"), v, 3).where("rank = 1 AND distance < 1e-6 AND query_id = vec_id")
    assert got.count() == 1000
    many = r.normal(size=(40_000, 4)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(40_000)), pa.FixedSizeListArray.from_arrays(pa.array(many.ravel()), 4).cast(pa.list_(pa.float32()))], names=["vec_id", "embedding"])
    tracemalloc.start()
    found = sum(b.num_rows for b in run[-1](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 3000 and peak < 64 << 20, (found, peak)


def test_long_chunks_are_split_a_few_at_a_time(spark, monkeypatch):
    run, text = [], "\n".join("line of words" for _ in range(400))
    rows = spark.createDataFrame([("a", "a:1", 1, "short"), ("a", "a:2", 2, text), ("b", "b:1", 1, None)], "document_id string, chunk_id string, sequence_no int, text string")
    real = type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema: run.append(f) or real(self, f, schema))
    got = segment.split_long(rows, 1000).orderBy("document_id", "sequence_no").collect()
    pieces = segment.split_text(text, 1000)
    assert [(r.document_id, r.chunk_id, r.sequence_no, r.text) for r in got] == [("a", "a:1", 1, "short"), *(("a", f"a:2:sub{i}", i + 2, p) for i, p in enumerate(pieces)), ("b", "b:1", 1, None)]
    n = 8000
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * n), pa.array(["c"] * n), pa.array(range(n), pa.int32()), pa.array([text] * n)], names=["document_id", "chunk_id", "sequence_no", "text"])
    tracemalloc.start()
    made = sum(b.num_rows for b in run[-1](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == n * len(pieces) and peak < 16 << 20, (made, peak)
