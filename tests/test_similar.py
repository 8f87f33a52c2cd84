"""Pairs by rare words against all pairs; answers cut by a plan against one at a time."""

import json
import random

from pyspark.sql import functions as F

from quillspark.operators import budget, search, similar
from quillspark.plans import api


def test_same_pairs_with_fewer_comparisons(spark):
    r = random.Random(3)
    common = [f"common{i}" for i in range(30)]
    texts = []
    for i in range(120):
        words = [f"word{r.randrange(4000)}" for _ in range(25)] + r.sample(common, 20)
        texts.append(" ".join(words))
        if i % 3 == 0:  # close ones: some words other, contained, equal
            near = list(words)
            for _ in range(r.randrange(1, 7)):
                near[r.randrange(len(near))] = f"other{r.randrange(99)}"
            texts += [" ".join(near), " ".join(words[3:-2]).upper(), " ".join(words) + "."]
    texts += ["a b c d e f g h i j k l m n o p q r s t " * 3, ("a b c d e f g h i j k l m n o p q r s t " * 3)[2:], "short", "", None, "x1y " * 30, "x1y " * 31]
    rows = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "k int, side int, t string").withColumn("g", F.lit("g"))
    left, right = rows.where("side = 0"), rows.where("side = 1")
    every = left.alias("a").crossJoin(right.alias("b")).where(search.strong_overlap(F.col("a.t"), F.col("b.t"))).select("a.k", "b.k")
    want = {tuple(x) for x in every.collect()}
    assert {tuple(x) for x in similar.similar_pairs(left, right, ["g"], "k", "t").collect()} == want
    compared = similar.candidate_pairs(left, right, ["g"], "k", "t").count()
    assert len(want) > 40 and compared < left.count() * right.count() / 10


def test_answers_cut_by_a_plan(spark):
    r = random.Random(9)
    fields = ["citation_id", "text", "page", "truncated", "note"]
    answers, cited, heads = {}, [], []
    for q in range(30):
        n = r.randrange(0, 9)
        rows = [{"citation_id": f"c{q}-{i}", "text": r.choice(["a", 'b "q" \\ \n', "é", "\U0001f600 x"]) * r.randrange(0, 400), "page": r.choice([None, 3, 12]), "truncated": False, "note": r.choice([None, "x"])} for i in range(n)]
        answers[q] = {"answerability": "partial", "filters_applied": {}, "citations": rows, "warnings": ["w"] * (q % 3)}
        heads.append((q, len(json.dumps(answers[q] | {"citations": []}, ensure_ascii=False, indent=2).encode("utf-16-le")) // 2))
        cited += [(q, i + 1, *x.values()) for i, x in enumerate(rows)]
    df = spark.createDataFrame(cited, "request_id int, rank int, citation_id string, text string, page int, truncated boolean, note string")
    for most in (300, 900, 2500):
        got = {}
        for x in budget.cut_to_budget(df, spark.createDataFrame(heads, "request_id int, head_chars int"), fields, most).orderBy("request_id", "rank").collect():
            got.setdefault(x["request_id"], []).append(({f: x[f] for f in fields}, x["dropped"]))
        for q, answer in answers.items():
            want = api.within_budget(answer, most)
            assert [c for c, _ in got.get(q, [])] == want["citations"]
            assert {d for _, d in got.get(q, [])} <= {len(answer["citations"]) - len(want["citations"])}
