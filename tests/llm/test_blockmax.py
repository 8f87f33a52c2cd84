"""Ranked search against a plain score of every document."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from quillspark.core import materialize
from quillspark.llm import blockmax
from quillspark.operators import keyword_index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    terms = [(i, words(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in terms), sum(len(w) for _, w in terms)
    df = {}
    for _, w in terms:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, q in asked.items():
        scores = []
        for i, w in terms:
            m = 50 + 50 * len(w) * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * w.count(x) // (1000 * w.count(x) + 20 * m)) for x in q if x in w)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus():
    r = np.random.default_rng(6)
    vocab = [f"Term{i}" for i in range(80)] + ["É", "naïve", "日本", "x1", "a_b"]
    p = 1 / np.arange(1, len(vocab) + 1)
    docs = [(int(i), " ".join(r.choice(vocab, int(r.integers(0, 60)), p=p / p.sum()))) for i in range(700)]
    docs += [(700 + i, docs[5][1]) for i in range(300)]  # one large group of copies
    docs += [(5000, None), (5001, ""), (5002, "!!"), (3, docs[3][1]), (None, docs[4][1])]
    return docs


ITEMS = [(1, "Term0 term1 Term40 NAÏVE naïve"), (2, "term70-term71 a_b É"), (3, None), (4, ""), (5, "unknown words only"), (6, "term0"), (7, "日本 x1"), (7, "term9 " * 50), (None, "term3 term2")]


def search(spark, docs, items, k=50):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit("clash"), "term": F.lit(1), "score": F.lit(0)})
    return blockmax.lexical_search(d, spark.createDataFrame(items, "item_id long, text string").withColumn("weight", F.lit(1)), k)


def test_every_score(spark):
    docs = corpus()
    got = search(spark, docs, ITEMS)
    assert rows(got) == plain(docs, ITEMS, 50)


def test_small_shards_and_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(keyword_index, "QUERY_BLOCK", 2)
    monkeypatch.setattr(keyword_index, "ROWS", 30)
    docs = corpus()
    d = spark.createDataFrame(docs, "key long, text string").repartition(5)
    n_docs, n_terms = blockmax.text_counts(d)

    def counted(batch):
        keys, terms, n = blockmax.words_of(batch)
        return keys, terms, n, 50 + 50 * n * n_docs // n_terms

    index = materialize(keyword_index.build(d, "bigint", lambda sizes: blockmax.impact, counted, shard_tokens=900), "index")
    assert index.where("term = ''").count() > 10
    asked = blockmax.item_terms(spark.createDataFrame(ITEMS, "item_id long, text string"), "item_id", "text").withColumn("weight", F.lit(1.0))
    got = keyword_index.top_rows(index, asked, 10_000, blockmax.impact).where("query_id = 6")
    # the query's one term is in so many documents, each found once
    assert got.count() == sum("term0" in words(t) for _, t in docs)


def test_long_text_in_pieces(monkeypatch):
    raw = ("Ab c" * 300 + " " + "Q" * 5000 + " z9 ü. " * 400).encode()
    whole = [w for part in blockmax.terms_of(raw) for w in part]
    monkeypatch.setattr(blockmax, "PIECE", 64)
    assert [w for part in blockmax.terms_of(raw) for w in part] == whole == [w.encode() for w in words(raw.decode())]


def test_empty(spark, empty):
    assert search(spark, [], ITEMS).count() == 0
    assert search(spark, [(1, "a")], []).count() == 0
    assert search(spark, [(1, None), (2, "..")], ITEMS).count() == 0
