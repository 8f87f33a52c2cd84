from collections import Counter

import numpy as np

from quillspark.llm.bagminhash import components, mix64, near_duplicates, overlaps, runs, signatures


def brute(rows, least=0.8):
    bags = []
    for _, t in rows:
        w = (t or "").encode().split()
        n = min(5, len(w))
        bags.append(Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter())
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, every = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if (both >= least * every) if every else rows[i][1] in (None, "") and rows[j][1] in (None, "") or rows[i][1] == rows[j][1]:
                a, b = name[i], name[j]
                name = [min(a, b) if x in (a, b) else x for x in name]
    return name


def groups(ids, names):
    out = {}
    for i, n in zip(ids, names, strict=True):
        out.setdefault(n, []).append(i)
    return sorted(map(sorted, out.values()))


def test_estimate_is_unbiased():
    rng = np.random.default_rng(1)
    e = mix64(np.arange(1, 301, dtype=np.uint64))
    wa = rng.integers(1, 9, 300)
    wb = np.maximum(1, wa + rng.integers(-2, 3, 300))
    s = signatures(np.concatenate([e, e]), np.concatenate([wa, wb]), np.repeat([0, 1], 300), 2, 8192)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((s[0] == s[1]).mean() - true) < 0.02


def test_runs():
    known = {}
    a, b = runs(b"a b c d e f".split(), known), runs(b"b c d e f".split(), known)
    assert len(a) == 2 and a[1] == b[0] and len(runs([], known)) == 0 and len(runs([b"a"], known)) == 1


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (50, 100)]
    got = {r["node"]: r["class"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[50], got[100], got[101]} == {50}


def test_classes(spark, odd, empty):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in rng.integers(0, 10_000, 300)]
    rows = [(r["doc_id"] or -1, r["text"]) for r in odd.collect()]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    for k in range(40):
        w = list(base)
        for at in rng.integers(0, 300, k % 8):
            w[at] = "edit"
        rows.append((100 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df).collect()
    assert groups([r["doc_id"] for r in got], [r["class"] for r in got]) == groups([i for i, _ in rows], brute(rows))
    assert near_duplicates(odd).count() == odd.count() and near_duplicates(empty).count() == 0


def test_overlaps():
    rng = np.random.default_rng(3)
    bags = [np.unique(rng.integers(0, 60 if k % 2 else 4000, 5 + k), return_counts=True) for k in range(200)]
    bags = [(e.astype(np.uint64), c) for e, c in bags]
    sets = [Counter(dict(zip(e.tolist(), c.tolist(), strict=True))) for e, c in bags]
    assert overlaps(bags).tolist() == [[sum((x & y).values()) for y in sets] for x in sets]


def test_pairs_inside_a_bucket_of_many_unlinked_texts(spark):
    # all share boilerplate below the threshold; pairs within are alike
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(150):
        own = [f"own{k}-{x}" for x in range(40)]
        rows.append((2 * k, " ".join(base + own)))
        rows.append((2 * k + 1, " ".join([*base, *own[:-32], *(f"end{k}-{x}" for x in range(32))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for more in ({}, {"block": 1 << 18}):
        got = near_duplicates(df, **more).collect()
        assert groups([r["doc_id"] for r in got], [r["class"] for r in got]) == groups([i for i, _ in rows], brute(rows))
        assert len({r["class"] for r in got}) == 150
