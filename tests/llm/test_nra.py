"""Exact top-k by sorted lists against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import nra

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors, queries, k, scale=256):
    def whole(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(scale * x) for x in v]

    rows = [(i, whole(v)) for i, v in vectors if i is not None and whole(v) is not None]
    out = []
    for q, v in queries:
        if q is None or whole(v) is None:
            continue
        scores = sorted((-sum(a * b for a, b in zip(w, whole(v))), i) for i, w in rows if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def many():
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 8))
    v = centres[r.integers(0, 6, 900)] + 0.4 * r.normal(size=(900, 8))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    v[300:600] = v[7]  # a third of all rows is one vector
    return [(int(i), [float(x) for x in v[i]]) for i in range(900)]


@pytest.mark.parametrize("group,block", [(4096, 4096), (64, 4096), (64, 3)])
def test_all_products(spark, many, monkeypatch, group, block):
    monkeypatch.setattr(nra, "GROUP", group)
    monkeypatch.setattr(nra, "LEAST_GROUP", 1)
    monkeypatch.setattr(nra, "BLOCK", block)
    df = spark.createDataFrame(many, SCHEMA).withColumns({"group": F.lit("x"), "key": F.lit(1), "v": F.lit(2)})
    got = nra.top_k(df, df.where("vec_id % 50 = 0"))
    assert rows(got) == plain(many, [r for r in many if r[0] % 50 == 0], 5)


def test_odd_rows(spark):
    data = [
        (0, [0.5, -0.25]), (1, None), (2, [0.5, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [1.0]), (7, [-1.0, 0.7, 0.2]), (None, [9.0, 9.0]),
        (8, [0.5, -0.25]), (8, [0.5, -0.25]), (0, [3.0, 3.0]), (50, [0.0, 0.0]), (100, []),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    padded = [(i, None if v is None else v + [0.0] * (3 - len(v))) for i, v in data]
    got = nra.top_k(df, df.where("vec_id % 50 = 0"), k=4)
    assert rows(got.withColumn("rank", F.lit(0))) == sorted((q, 0, i, s) for q, _, i, s in plain(padded, [r for r in padded if r[0] is not None and r[0] % 50 == 0], 4))


def test_great_numbers(spark):
    data = [(i, [float((-1) ** i * 2**21), float(i)]) for i in range(40)]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(nra.top_k(df, df.where("vec_id % 10 = 0"), k=3)) == plain(data, data[::10], 3)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert nra.top_k(df, df).count() == 0
    some = spark.createDataFrame([(0, [1.0])], SCHEMA)
    assert nra.top_k(some, df).count() == nra.top_k(df, some).count() == nra.top_k(some, some).count() == 0


def test_reading_stops_early():
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 8))
    v = np.floor(256 * (centres[np.arange(4000) % 20] + 0.05 * r.normal(size=(4000, 8)))).astype(np.int64)
    lists = nra.SortedLists(v)
    none = [np.array([], np.int64)] * 40
    q = v[:40]
    exact = q @ v.T
    kth = np.sort(exact, axis=1)[:, -5].astype(float)
    reads = {}
    for name, floors in (("none", np.full(40, -np.inf)), ("told", kth)):
        found = {i: (rows, read) for i, rows, read in lists.candidates(q, 5, floors, none)}
        assert sorted(found) == list(range(40))
        for i, (rows, _) in found.items():
            assert set(np.lexsort((np.arange(4000), -exact[i]))[:5]) <= set(rows)
        reads[name] = np.mean([read for _, read in found.values()])
    assert reads["told"] <= reads["none"] < 0.7
