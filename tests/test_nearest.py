"""Nearest neighbours out of clusters against all distances, and the share of rows measured."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import nearest


def plain(v, queries, k):
    out = []
    for q in queries:
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        out += [(q, int(i), r) for r, i in enumerate(np.lexsort((np.arange(len(v)), d))[:k], 1)]
    return sorted(out)


def table(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")


def run(spark, v, k, **how):
    df = table(spark, v)
    clusters = nearest.cluster(df, **how)
    assert clusters.rows.count() == len(v)
    asked = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got, read = nearest.nearest_in_clusters(asked, clusters, k)
    share = read.agg(F.sum("compared")).first()[0] / len(v) / asked.count()
    return sorted((r["query_id"], r["vec_id"], r["rank"]) for r in got.collect()), share


def test_clustered_vectors_measure_few_rows(spark):
    r = np.random.default_rng(1)
    v = 10 * r.normal(size=(40, 12))[r.integers(0, 40, 3000)] + r.normal(size=(3000, 12))
    got, share = run(spark, v, 5, block_rows=30)
    assert got == plain(v, range(0, 3000, 20), 5)
    assert share < 0.3


@pytest.mark.parametrize("pivots,block_rows", [(1, 10_000), (30, 7)])
def test_vectors_without_structure_and_copies(spark, pivots, block_rows):
    r = np.random.default_rng(2)
    v = np.round(r.normal(size=(600, 6)), 1)
    v[100:300] = v[0]  # a third of all rows is one vector
    got, _ = run(spark, v, 9, pivots=pivots, block_rows=block_rows)
    assert got == plain(v, range(0, 600, 20), 9)


def test_fewer_rows_than_asked_for(spark):
    got, _ = run(spark, np.arange(6.0).reshape(3, 2), 5)
    assert len(got) == 3
    df = table(spark, np.zeros((2, 2)))
    clusters = nearest.cluster(df)
    none = df.where("vec_id < 0").withColumnRenamed("vec_id", "query_id")
    assert nearest.nearest_in_clusters(none, clusters, 2)[0].count() == 0
