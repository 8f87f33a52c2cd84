from pyspark.sql import functions as F

from quillspark.core import materialize
from quillspark.functions import text as X
from quillspark.operators import corpus, evaluate, navigate, search


def test_discovery_filter(spark):
    titles = {
        "Final report on Guidelines on something": True, "Consolidated amending Guidelines on X": True, "Final report on draft RTS on Y": True, "Opinion on Z": True, "Recommendations on cloud": True,
        "Consultation paper on Guidelines": False, "Draft RTS on Y": False, "Guidelines amending Guidelines": False, "Annex to Guidelines": False, "Guidelines templates": False, "Annual report": False, None: False,
    }
    rows = spark.createDataFrame([(t,) for t in titles], "title string")
    got = {r[0]: r[1] for r in rows.select("title", corpus.current_candidate(F.col("title"), F.lit("https://x/a.pdf"))).collect()}
    assert got == titles


def test_files_and_dates(spark):
    rows = spark.createDataFrame([("https://x/2021-03/Guide_EN.pdf?v=1",), ("https://x/guide_FR.pdf",), ("https://x/a.html",)], "u string")
    got = rows.select(corpus.english_file(F.col("u")), X.date_from_path(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [(True, "2021-03"), (False, None), (False, None)]
    dates = spark.createDataFrame([("3 May 2021",), ("2021-05-03",), ("3 Foo 2021",), (None,)], "t string").select(X.written_date(F.col("t"))).collect()
    assert [r[0] for r in dates] == ["2021-05-03", "2021-05-03", None, None]


def test_edges(spark):
    rows = spark.createDataFrame([("AB/GL/2021/01", "Amending AB/GL/2019/01 and repealing AB/GL/2019/01. Replaces AB/GL/2021/01"), ("AB/GL/2021/02", None)], "document_id string, notes string")
    assert [tuple(r) for r in corpus.edges_from_notes(rows).select("source", "target", "type").collect()] == [("AB/GL/2021/01", "AB/GL/2019/01", "repeals")]
    text = spark.createDataFrame([("AB/GL/2021/01", "Consolidated version", "see AB-RTS-2020-05 and AB/GL/2021/01")], "document_id string, title string, text string")
    assert [tuple(r) for r in corpus.edges_from_text(text).collect()] == [("AB/GL/2021/01", "AB/RTS/2020/05", "consolidates")]


def test_primary_id(spark):
    rows = spark.createDataFrame([([], "t"), (["A/GL/1/1"], "t"), (["A/RTS/1/1", "A/GL/1/2"], "t"), (["A/GL/1/2", "A/GL/1/1"], "Consolidated"), (["A/GL/1/1", "A/GL/1/2"], "t"), (["A/ITS/1/1", "A/RTS/1/2"], "t")], "refs array<string>, title string")
    got = [tuple(r[0]) for r in rows.select(corpus.primary_id(F.col("refs"), F.col("title"), F.lit("guidelines"))).collect()]
    assert got == [(None, "unresolved"), ("A/GL/1/1", "high"), ("A/GL/1/2", "high"), ("A/GL/1/1", "medium"), ("A/GL/1/2", "medium"), ("A/ITS/1/1", "medium")]


def test_duplicate_summary(spark):
    rows = spark.createDataFrame([("dup-1",), ("dup-1",), ("dup-2",), ("dup-2",), ("ok-1",)], "id string")
    assert [tuple(r) for r in corpus.duplicate_ids(rows, "id").collect()] == [(2, 2, ["dup-1", "dup-2"])]


CHUNK = "version_id int, chunk_id string, section_ref string, section_title string, section_level int, parent_section_ref string, chunk_type string, document_region string, metadata_confidence double, page_start int, page_end int, sequence_no int"


def test_hierarchy(spark):
    rows = [(1, "a", "1", "t", 1, None, "made_up", "body", 1.0, 1, 1, 1), (1, "b", "4.1", "t", 2, "4", "paragraph", "body", 1.0, 1, 1, 2)]
    got = {tuple(r) for r in evaluate.hierarchy_failures(spark.createDataFrame(rows, CHUNK)).collect()}
    assert got == {("a", "invalid_chunk_type"), ("b", "missing_parent_section")}
    assert evaluate.hierarchy_failures(spark.createDataFrame([], CHUNK)).count() == 0


def test_outline_and_sanitize(spark):
    rows = [
        (1, "f", None, None, None, None, "front_matter", "front_matter", 1.0, 1, 1, 1), (1, "a", "1", "1. Scope", 1, None, "paragraph", "body", 0.97, 2, 2, 2), (1, "b", "1", "other", 1, None, "paragraph", None, 0.91, 3, 3, 3),
        (1, "c", "A1", "Annex I", 1, None, "annex", "annex", 0.9, 10, 10, 4), (1, "d", "9.9", "x", 2, "9", "paragraph", "consultation_feedback", 0.9, 11, 11, 5),
    ]
    df = spark.createDataFrame(rows, CHUNK)
    got = navigate.outline(df).orderBy(*navigate.outline_order()).select("section_ref", "title", "page_start", "page_end", "sequence_start", "sequence_end", "confidence").collect()
    assert [tuple(r) for r in got] == [("1", "1. Scope", 2, 3, 2, 3, 0.97), ("A1", "Annex I", 10, 10, 4, 4, 0.9)]
    fixed = {r["chunk_id"]: (r["section_ref"], r["parent_section_ref"], r["metadata_confidence"]) for r in navigate.sanitize_sections(df, F.lower("section_title") == "other").collect()}
    assert fixed["b"][0] is None and fixed["d"] == ("9.9", None, 0.85) and fixed["a"] == ("1", None, 0.97)
    cover = evaluate.outline_coverage(df, navigate.outline(df).where("section_ref = '1'")).collect()[0]
    assert (cover["eligible"], cover["covered"], cover["missing"], cover["coverage"]) == (2, 1, 1, 0.5)
    assert evaluate.navigation_differences(navigate.outline(df), navigate.outline(df)).count() == 0


def test_demotion(spark):
    text = " ".join(f"word{i:03d}" for i in range(40))
    rows = [(1, "g", "X/LARGE-GL/0000/0001", "4", text, 1), (1, "c", "X/GL/2021/01", "4", text.upper(), 2), (1, "o", "X/LARGE-GL/0000/0002", "5", text, 3)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, document_id string, paragraph_ref string, text string, rank int")
    got = search.demote_generated(df, F.col("document_id").contains("/LARGE-"), X.series_code(F.col("document_id")), "paragraph_ref", "text").orderBy("rank").select("chunk_id").collect()
    assert [r[0] for r in got] == ["c", "o", "g"]


def test_query_terms():
    assert search.query_terms('Money AND "laundering" or NOT a_b é*') == ["money", "laundering", "a", "b"]


def test_bm25_against_sqlite(spark):
    import sqlite3

    texts = ["the cat sat", "the dog sat on the cat", "a bird", "cat cat cat dog", ""]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(texts, 1)))
    want = {r[0]: round(-r[1], 9) for r in con.execute("SELECT rowid, rank FROM t WHERE t MATCH 'cat AND dog'")}
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "chunk_id long, text string")
    index = materialize(search.build_index(docs, ["text"]), "index")
    asked = spark.createDataFrame([(1, "cat"), (1, "dog")], "query_id long, term string")
    got = search.keyword_hits(index, asked, 10)
    assert {r["key"]: r["score"] for r in got.collect()} == {k: round(v, 6) for k, v in want.items()}
    assert {r["mode"] for r in got.collect()} == {"and"}


def test_pages(spark):
    rows = spark.createDataFrame([(1, "a\f \fHEAD\nb"), (2, None)], "document_id int, text string")
    assert [(r["document_id"], r["page_no"]) for r in corpus.page_split(rows).orderBy("page_no").collect()] == [(1, 1), (1, 3)]
    pages = spark.createDataFrame([(1, i, f"HEAD\nbody {i}\nHEAD") for i in range(1, 4)], "document_id int, page_no int, text string")
    edge = corpus.repeated_edge_lines(pages)
    assert [(r["line"], r["pages"]) for r in edge.collect()] == [("HEAD", 3)]
    assert [r["text"] for r in corpus.without_lines(pages, edge).orderBy("page_no").collect()] == ["body 1", "body 2", "body 3"]
    assert [r["line"] for r in corpus.noise_lines(pages).collect()] == ["HEAD"]
