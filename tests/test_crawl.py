"""Crawls, ids and extraction against sequential folds."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import corpus, crawl


def fold(pages, limit, patience=2):
    """pages: {kind: [[(url, wanted)]]} in order."""
    seen, out = set(), []
    for kind in sorted(pages):
        for no, links in enumerate(pages[kind]):
            if not links:
                break
            new = 0
            for pos, (url, wanted) in enumerate(links):
                if url in seen or not wanted:
                    continue
                seen.add(url)
                out.append((kind, no, pos, url, len(out) + 1))
                new += 1
                if limit is not None and len(out) >= limit:
                    return out
            if new == 0 and no > patience:
                break
    return out


@pytest.mark.parametrize("seed,limit", [(1, None), (2, None), (3, 9), (4, None)])
def test_listings_by_stop_rules(spark, seed, limit):
    r = random.Random(seed)
    pages = {k: [[(f"u{r.randrange(14 + 3 * k)}", r.random() < 0.7) for _ in range(r.choice([0, 1, 2, 2, 3] if i > 4 else [1, 2, 3]))] for i in range(9)] for k in range(4)}
    rows = [(k, i, p, u, w) for k, ps in pages.items() for i, ls in enumerate(ps) for p, (u, w) in enumerate(ls)]
    links = spark.createDataFrame(rows, "kind int, page_no int, pos int, url string, wanted boolean").withColumn("title", F.lit("t"))
    counts = spark.createDataFrame([(k, i, len(ls)) for k, ps in pages.items() for i, ls in enumerate(ps)], "kind int, page_no int, n_links int")
    got = crawl.listing_crawl(counts, links.where("wanted"), limit)
    assert sorted(tuple(x) for x in got.select("kind", "page_no", "pos", "url", "sequence").collect()) == sorted(fold(pages, limit))


def ids_fold(docs):
    """(position, original, slug, refs, picked, confidence) in order, one after the other."""
    seen, results, out = {}, [], []
    for _, original, slug, refs, picked, confidence in docs:
        generated = "/LARGE-" in original
        if refs is None or not picked:
            results.append(None)
            out.append((None, "unresolved", "no text" if refs is None else "no reference in the text", None))
            continue
        claim = picked if generated else original
        said = "high" if not generated and picked.upper() == original.upper().replace("-", "/") else confidence
        n = sum(1 for x in results if x and x.startswith(claim))
        if claim in seen:
            final, said = f"{claim}/DUP{n + 1}", "low" if generated else said
            out.append((final, said, "collision", seen[claim]))
        else:
            final = claim
            seen[claim] = slug
            out.append((final, said, None, None))
        results.append(final)
    return out


def test_ids_with_collisions(spark):
    r = random.Random(8)
    names = ["A/GL/2020/1", "A/GL/2020/10", "A/GL/2020/101", "A/RTS/2021/7"]
    docs = []
    for i in range(60):
        generated = r.random() < 0.6
        refs = None if r.random() < 0.1 else r.sample(names, r.randrange(0, 3))
        picked = refs[0] if refs else None
        docs.append((i, f"A/LARGE-GL/0000/{i:04d}" if generated else r.choice(names), f"slug-{i}", refs, picked, "high" if picked else "unresolved"))
    df = spark.createDataFrame(docs, "position int, original_id string, slug string, refs array<string>, p string, c string").select("position", "original_id", "slug", "refs", F.struct(F.col("p").alias("id"), F.col("c").alias("confidence")).alias("picked"))
    got = crawl.claimed_ids(df, F.contains("original_id", F.lit("/LARGE-"))).orderBy("position").collect()
    want = ids_fold(docs)
    assert [(x["final_id"], x["confidence"], x["reason"], x["collides_with"]) for x in got] == want
    assert all(x["final_id"] or x["reason"] for x in got) and sum(w[2] == "collision" for w in want) > 20


def test_generated_ids(spark):
    rows = [("Guidelines ABC-GL-2021-05 final", "https://x/y.pdf", "guidelines", 3), ("no id", "https://x/2019-04/z.pdf", "opinion", 12345), (None, None, "other", 7)]
    df = spark.createDataFrame(rows, "title string, url string, kind string, n int")
    got = df.select(crawl.generated_id(F.col("title"), F.col("url"), F.col("kind"), F.col("n"), "AUTH", {"guidelines": "GL", "opinion": "Op"}).alias("id")).collect()
    assert [r["id"] for r in got] == ["ABC/GL/2021/05", "AUTH/LARGE-Op/2019/12345", "AUTH/LARGE-DOC/0000/0007"]


def test_extraction_with_fallback(spark):
    docs = spark.createDataFrame([("a", "x\fy"), ("b", "bad one"), ("c", "worse bad"), ("d", "old"), (None, "q"), ("e", "")], "document_id string, text string")
    pages = F.transform(F.split("text", "\f"), lambda t: F.struct(t.alias("text")))
    none = F.lit(None).cast("string")
    primary = F.struct(pages.alias("pages"), F.when(F.contains("text", F.lit("bad")), "primary says no").otherwise(none).alias("error"))
    fallback = F.struct(pages.alias("pages"), F.when(F.contains("text", F.lit("worse")), "fallback says no").otherwise(none).alias("error"))
    done = spark.createDataFrame([("d",), ("z",)], "document_id string")
    got, report = crawl.extract_with_fallback(docs, done, primary, fallback)
    told = {r["document_id"]: tuple(r)[1:] for r in report.collect()}
    assert told == {"a": ("primary", None, None), "b": ("fallback", "primary says no", None), "c": ("failed", "primary says no", "fallback says no"), "d": ("skipped", None, None), None: ("primary", None, None), "e": ("primary", None, None)}
    assert sorted((r["document_id"] or "", r["page"]["text"]) for r in got.collect()) == [("", "q"), ("a", "x"), ("a", "y"), ("b", "bad one"), ("e", "")]


def test_references_make_claims(spark):
    df = spark.createDataFrame([("see AB-GL-2020-01, AB/GL/2020/01 or ABC/RTS/2021/2", "rts")], "text string, kind string")
    refs = corpus.references(F.col("text"))
    got = df.select(refs.alias("refs"), corpus.primary_id(refs, F.lit("t"), F.col("kind"))["id"].alias("id")).first()
    assert tuple(got) == (["AB/GL/2020/01", "ABC/RTS/2021/2"], "ABC/RTS/2021/2")
