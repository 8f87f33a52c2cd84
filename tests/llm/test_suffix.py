import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from quillspark.llm.suffix_dedup import common_prefixes, remove_repeats, two_stage_order


def brute(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        cut = np.zeros(len(b) + 1, dtype=int)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                cut[p] += 1
                cut[p + length] -= 1
        cover = np.cumsum(cut)[:-1] > 0
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out[(d, len(b), int(cover.sum()), spans, sha256(kept).hexdigest())] += 1
    return out


def test_order_and_prefixes():
    random.seed(4)
    for _ in range(80):
        n, letters = random.randrange(1, 200), random.choice([1, 2, 4, 200])
        b = bytes(random.randrange(letters) for _ in range(n))
        t = np.frombuffer(b, dtype=np.uint8)
        order = two_stage_order(t, n + 8)
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
        got = common_prefixes(t, order, 24)
        for k in range(1, n):
            x, y = b[order[k] :] + bytes(40), b[order[k - 1] :] + bytes(40)
            assert got[k] == next((i for i in range(24) if x[i] != y[i]), 24)


@pytest.mark.parametrize("hot", [4096, 1])
def test_against_brute_force(spark, odd, hot):
    random.seed(hot)
    passage = "".join(random.choice("abcé ") for _ in range(300))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] != 6]
    for k in range(30):
        fill = lambda n: "".join(random.choice("xyz ") for _ in range(n))
        rows.append((50 + k, fill(random.randrange(90)) + passage[: random.randrange(20, 300)] + fill(random.randrange(60))))
    rows += [(90, "ab" * 150), (91, "q" * 99), (92, "q" * 100), (93, "r" * 101)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in remove_repeats(df, length=100, gram=24, hot=hot).collect())
    assert got == brute(rows, 100)


def test_odd(odd, empty):
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in remove_repeats(odd).collect()}
    assert (6, 30_000, 30_000) in got and (4, 0, 0) in got and (5, 0, 0) in got
    assert remove_repeats(empty).count() == 0
