"""Pairs of shared bands and the rounds over them stay as many as nodes, however many bands a group shares."""

import numpy as np

from quillspark.llm import bagminhash


def plain(links):
    of = {}

    def top(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        of[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(of)}


def test_a_large_group_has_few_pairs(spark):
    r = np.random.default_rng(1)
    # each node is missing from half of the bands, so bands have many different least nodes; and small groups
    buckets = [(n, b) for n in range(2000) for b in range(32) if r.random() < 0.5] + [(n, 1000 + n // 3) for n in range(5000, 5600)]
    pairs = [tuple(x) for x in bagminhash._pairs_within(spark.createDataFrame(buckets, "node long, band long").repartition(4)).collect()]
    assert len(pairs) < 2 * 2600 and all(a < b for a, b in pairs)
    by_band = {}
    for n, b in buckets:
        by_band.setdefault(b, []).append(n)
    assert plain(pairs) == plain([(x[0], y) for x in by_band.values() for y in x[1:]])


def test_links_inside_a_class_fall_away(spark, monkeypatch):
    r = np.random.default_rng(2)
    links = [tuple(int(v) for v in x) for x in r.integers(0, 3000, (2500, 2))] + [(i, i + 1) for i in range(5000, 5200)] + [(9999, i) for i in range(6000, 6300)]
    sizes, real = [], bagminhash.materialize
    monkeypatch.setattr(bagminhash, "materialize", lambda df, name, *a: sizes.append((name, df.count())) or real(df, name, *a))
    got = {x["node"]: x["class"] for x in bagminhash.components(spark.createDataFrame(links, "a long, b long"), "c").collect()}
    assert got == plain(links)
    rounds = [n for name, n in sizes if "links-" in name]
    assert rounds == sorted(rounds, reverse=True) and rounds[-1] == 0 and sum(rounds) < len(links)
