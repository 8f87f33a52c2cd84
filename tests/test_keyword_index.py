"""Packed postings, and pruned search against plain sums over all rows."""

import numpy as np
import pyarrow as pa
import pytest

from quillspark.operators import blocks


def test_packing_round_trip():
    r = np.random.default_rng(2)
    numbers = np.concatenate([np.arange(300), 2 ** r.integers(0, 62, 500), [0, 127, 128, 2**62]])
    data, ends = blocks.pack(numbers)
    assert (blocks.unpack(data) == numbers).all() and ends[-1] == len(data)
    assert len(blocks.unpack(blocks.pack(np.zeros(0, np.int64))[0])) == 0


def share(tf, size):
    return tf * 2.2 / (tf + 0.3 + 0.9 * size / 40)


def shard(texts, impact=share, keys=None):
    lengths = np.array([len(t) for t in texts], np.int64)
    keys = pa.array(range(len(texts))) if keys is None else keys
    batches = list(blocks.shard_rows("s", keys, pa.array([w for t in texts for w in t], pa.string()), lengths, lengths, impact, batch=7))
    return pa.Table.from_batches(batches)


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(3)
    return [[f"w{int(x)}" for x in r.zipf(1.4, r.integers(0, 80)) if x < 300] for _ in range(3000)]


def plain(texts, weights, every=False):
    out = []
    for i, t in enumerate(texts):
        if every and not set(weights) <= set(t):
            continue
        s = sum(w * share(np.float64(t.count(x)), len(t)) for x, w in weights.items() if x in t)
        if s > 0:
            out.append((-round(s, 6), i))
    return [i for _, i in sorted(out)]


def test_best_rows(texts):
    table = shard(texts)
    names = table.column("term").to_pylist()
    r = np.random.default_rng(4)
    for _ in range(25):
        terms = {f"w{int(x)}" for x in r.integers(1, 60, 6)} & set(names)
        weights = {t: float(r.uniform(0.1, 5)) for t in sorted(terms)}
        s = blocks.Shard(table, share)
        lists = np.array([names.index(t) for t in weights])
        got, sums = s.best(lists, np.array(list(weights.values())), 10, digits=6)
        assert got.tolist() == plain(texts, weights)[:10]
        assert (np.diff(np.round(sums, 6)) <= 0).all()
        two = dict(list(weights.items())[:2])
        got, _ = s.best_of_all(np.array([names.index(t) for t in two]), np.array(list(two.values())), 10, digits=6)
        assert got.tolist() == plain(texts, two, every=True)[:10]


def test_blocks_below_the_bar_stay_packed():
    # the best rows lie together, so the blocks of all others are passed over
    texts = [["a"] * (9 if 1000 <= i < 1100 else 1) + ["b"] * (i % 2) for i in range(20_000)]
    table = shard(texts, impact=lambda tf, size: tf * 1.0)
    names = table.column("term").to_pylist()
    s = blocks.Shard(table, lambda tf, size: tf * 1.0)
    got, _ = s.best(np.array([names.index("a"), names.index("b")]), np.array([1.0, 0.5]), 10)
    assert got.tolist() == list(range(1001, 1021, 2))
    assert s.blocks_read < 60 < s.offsets[-1] / 3


def test_a_shard_of_nothing():
    table = shard([[], []])
    assert table.num_rows == 1 and table.column("keys").to_pylist() == [[0, 1]]
    assert shard([["x", "x"], []], keys=pa.array(["b", None])).column("cf").to_pylist() == [None, 2]
