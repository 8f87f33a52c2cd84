from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm.mixing import MixConfig, block_ranks, mix, split_tree, water_fill


def test_water_fill():
    assert water_fill([100, 100], [5, 2], 150, [200, 200]) == pytest.approx([150 * 5 / 7, 150 * 2 / 7])
    got = water_fill([10, 100, 100], [5, 2, 1], 315, [20, 200, 200])
    assert got[0] == 20 and sum(got) == pytest.approx(315) and got[1] == pytest.approx(295 * 2 / 3)
    assert water_fill([], [], 0, []) == []


def test_tree_is_exact():
    q = np.array([17, 0, 5, 40])
    t = split_tree(q, 7, 1)
    assert t.sum(axis=0).tolist() == q.tolist() and max(t.sum(axis=1)) - min(t.sum(axis=1)) <= 1 and (t >= 0).all()
    assert (split_tree(q, 7, 1) == t).all()


def test_mix(spark, odd, empty):
    rows = [(i, " ".join(["x"] * (5 + i % 40)), ["a", "b", "c", None][i % 4]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cfg = MixConfig(block_words=500, shards=5, bucket_rows=200)
    draws, docs = mix(df, cfg)
    docs = docs.collect()
    by = defaultdict(int)
    for r in docs:
        by[r["source"]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    for r in docs:
        assert abs(by[r["source"]] - r["target"]) <= 45
    d = draws.collect()
    assert sum(r["size"] for r in d) == sum(by.values())
    assert len({(r["source"], r["pass"], r["block"], r["shard"]) for r in d}) == len({(r["source"], r["pass"], r["block"]) for r in d})
    again = mix(df.repartition(7), cfg)[0].collect()
    key = lambda r: (r["doc_id"], r["pass"], r["block"], r["shard"], r["place"])
    assert Counter(map(key, d)) == Counter(map(key, again))
    _, odd_docs = mix(odd)
    assert odd_docs.count() == odd.count() and all(r["taken"] <= 2 * r["size"] for r in odd_docs.collect())
    assert mix(empty)[1].count() == 0


def test_block_ranks_over_buckets(spark):
    blocks = spark.createDataFrame([(s, p, b) for s in ["a", None] for p in (0, 1) for b in range(300)], "source string, pass int, block long")
    many = block_ranks(blocks, 1200, MixConfig(bucket_rows=50)).collect()
    for s in ("a", None):
        assert sorted(r["at"] for r in many if r["source"] == s) == list(range(600))
    # the order is the hash's, whatever the number of buckets
    assert Counter(many) == Counter(block_ranks(blocks, 1200, MixConfig()).collect())
