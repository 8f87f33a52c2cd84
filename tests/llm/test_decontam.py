import re
from collections import Counter

import pytest

from quillspark.llm.decontam import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, span=10):
    windows = {}
    for i, t in items:
        w = fold(t)
        n = min(span, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i or "")
    out = Counter()
    for d, t in docs:
        w, hit, found = fold(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if got := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= got
        out[(d, len(w), len(hit), tuple(sorted(found)))] += 1
    return out


@pytest.mark.parametrize("rows", [50_000, 3])
def test_against_brute_force(spark, odd, rows):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(20, "W0, w1! w2 w3 w4 w5 w6 w7 w8 w9"), (21, "É é Alone WORD"), (22, "a a a a a a a a a a a a a")]
    items = [("i1", " ".join(f"w{i}" for i in range(20))), ("i1", "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), ("i2", "alone word"), ("i3", None), (None, "a " * 11), ("i4", "é"), ("i5", "b a a a a a a a a a")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id string, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in contamination(d, i, broadcast_rows=rows).collect())
    assert got == brute(docs, items)


def test_empty_sides(spark, odd, empty):
    none = spark.createDataFrame([], "item_id string, text string")
    assert all(r["n_hit"] == 0 for r in contamination(odd, none).collect())
    assert contamination(empty, none).count() == 0
