"""The filter audit against a plain walk through every order."""

from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import audit


def walk(docs, labels):
    """Rows by removing documents one filter after another."""
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}

    def fails(i, text):
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
        capitals = sum("A" <= c <= "Z" for c in text)
        out = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * capitals > 5 * len(text), "D": any(c in "#$%&*|" for c in text)}
        out["E"] = i is not None and any(o is not None and o < i and (t or "") == text for o, t, _ in docs)
        return {k for k, v in out.items() if v}

    rows = [(i, s or "", fails(i, t or "")) for i, t, s in docs]
    found = {}
    for part in {s for _, s, _ in rows}:
        mine = [(i, f) for i, s, f in rows if s == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, x in enumerate(order, 1):
                out = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(out)
                fail = sum(x in f for _, f in mine)
                found[part, order, k] = [x, len(left), len(out), fail - len(out), sum(f == {x} for _, f in mine), sum(i in good for i, _ in out), sum(i in toxic for i, _ in out)]
        for (p, _, _), v in found.items():
            if p == part:
                v.append(shapley[v[0]])
    return {k: tuple(v[1:]) for k, v in found.items()}


def as_dict(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def fixture():
    prose = " ".join(f"word{i}" for i in range(60))
    return [
        (1, prose, "a"), (2, prose, "a"), (2, prose, "a"), (3, prose.upper(), "b"), (4, None, "a"), (5, "", None), (None, "", ""), (None, prose, "a"), (6, "same " * 80, "b"),
        (7, prose + " 5 % off", "a"), (8, "same " * 80, "a"), (9, "ÀÉ x " * 60, "b"), (10, "A" * 3_000_000, "b"), (11, "A b\v" * 600_000, "b"), (12, "#" + prose.upper(), None),
    ]


def test_every_order(spark):
    docs = fixture()
    labels = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (5, None, 1), (8, 1, None), (8, 0, 1), (None, 1, 1), (7, 1, 0)]
    got = audit.filter_audit(spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("part", F.lit("clash")).withColumn("failed", F.lit(9)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert as_dict(got) == walk(docs, labels)


def test_table_is_first_failure():
    table = audit.first_failures()
    assert table.shape == (32, 120)
    for mask in range(32):
        for k, order in enumerate(audit.ORDERS):
            failing = [s for s, f in enumerate(order) if mask >> "ABCDE".index(f) & 1]
            assert table[mask, k] == (failing[0] if failing else 5)


def test_many_parts_are_given_on(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 700).cast("string").alias("part"), (F.col("id") % 32).cast("int").alias("failed"), (F.col("id") % 2).cast("int").alias("good"), F.lit(0).alias("toxic")).coalesce(1)
    got = audit.order_counts(rows).select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.count("*").alias("orders"), F.max("n").alias("n"))
    shown = got.agg(F.count("*"), F.min("orders"), F.max("orders")).first()
    assert tuple(shown) == (700, 120, 120)


def test_counts_use_all_labels(spark):
    rows = spark.createDataFrame([("p", 1, g, t) for g in (0, 1) for t in (0, 1) for _ in range(1 + g + 2 * t)], "part string, failed int, good int, toxic int")
    counts = np.array([r["counts"] for r in audit.order_counts(rows).orderBy("order_no").collect()]).reshape(120, 6, 3)
    first = np.array([o.index("A") for o in audit.ORDERS])
    assert (counts[np.arange(120), first] == [10, 6, 7]).all()
    assert counts.sum() == 120 * 23


def test_empty(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(empty, labels).count() == 0
