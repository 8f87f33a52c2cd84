"""Composed reads on small tables, and the evaluation that runs over them."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import corpus, evaluate, navigate
from quillspark.plans import reads

CHUNK = "document_id string, version_id int, language string, chunk_id string, sequence_no int, paragraph_ref string, section_path string, text string, page_start int, page_end int, document_region string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("A", 1, "en", "a1", 1, None, "1. Scope", "1. Scope", 1, 1, "front_matter"), ("A", 1, "en", "a2", 2, "4.1", "1. Scope", "4.1 first", 1, 2, "body"), ("A", 1, "en", "a3:sub1", 3, "4.2", "2. Duties", "2. Duties", 2, 2, "body"),
        ("A", 1, "fr", "a4", 4, "4.1", "2. Duties", "en", 2, 2, "body"), ("A", 1, "en", "a5", 5, "4.1", "2. Duties", "again", 3, 3, "body"), ("B", 2, "en", "b1", 1, "4.1", "1. Other", "1. Other", 1, 1, "body"),
    ]
    return spark.createDataFrame(rows, CHUNK)


def test_aliases_and_overrides(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "E")], "target string, source string")
    asked = spark.createDataFrame([("A",), ("B",), ("D",), ("Z",), (None,)], "document_id string")
    got = {r["requested_id"]: (r["document_id"], r["alias_note"]) for r in reads.resolved(asked, edges, {"D": "Q"}).collect()}
    assert got == {"A": ("B", "A resolved to B"), "B": ("C", "B resolved to C"), "D": ("Q", "D resolved to Q"), "Z": ("Z", None), None: (None, None)}


def test_paragraphs_with_context(spark, chunks):
    asked = spark.createDataFrame([(1, "A", "4.1", None), (2, "A", "4.1", "fr"), (3, "A", "9", None), (4, "B", "4.1", "en")], "query_id int, document_id string, paragraph_ref string, language string")
    bare = {}
    for r in reads.paragraphs(asked, chunks).orderBy("query_id", "place").collect():
        bare.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert bare == {1: ["a2", "a5"], 2: ["a4"], 4: ["b1"]}
    wide = [(r["chunk_id"], r["is_anchor"], r["is_complete"]) for r in reads.paragraphs(asked.where("query_id = 1"), chunks, 1, 1).orderBy("place").collect()]
    assert wide == [("a1", False, True), ("a2", True, True), ("a3:sub1", False, False), ("a4", True, True), ("a5", True, True)]


def test_document_heads_and_outlines(spark, chunks):
    asked = spark.createDataFrame([(1, "A"), (2, "B"), (3, "none")], "query_id int, document_id string")
    got = [(r["query_id"], r["chunk_id"]) for r in reads.document_heads(asked, chunks, 2).orderBy("query_id", "place").collect()]
    assert got == [(1, "a2"), (1, "a3:sub1"), (2, "b1")]
    versions = spark.createDataFrame([("A", 1, True, "2020"), ("A", 0, False, "2024"), ("B", 2, False, None)], "document_id string, version_id int, is_current boolean, published_at string")
    stored = spark.createDataFrame([(2, "9", "Kept", 1, 7), (2, "8", "First", 1, 3), (0, "1", "Old", 1, 1)], "version_id int, section_ref string, title string, level int, sequence_start int")
    shown = [tuple(r) for r in reads.outlines(asked, versions, chunks, stored).orderBy("query_id", "place").select("query_id", "origin", "section_ref", "title").collect()]
    assert shown == [(1, "folded", "1", "1. Scope"), (1, "folded", "2", "2. Duties"), (2, "stored", "8", "First"), (2, "stored", "9", "Kept")]


def test_versions_and_differences(spark):
    docs = spark.createDataFrame([("A",), ("B",)], "document_id string")
    versions = spark.createDataFrame([("A", 1, "v1", "2020-01-01", "h1", False), ("A", 2, "v2", "2021-01-01", "h2", True), ("A", 3, "v3", None, "h1", False)], "document_id string, version_id int, version_label string, published_at string, file_sha256 string, is_current boolean")
    asked = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "query_id int, document_id string")
    got = [(r["query_id"], r["found"], r["place"], r["version_id"]) for r in reads.version_lists(asked, docs, versions).orderBy("query_id", "place").collect()]
    assert got == [(1, True, 1, 2), (1, True, 2, 1), (1, True, 3, 3), (2, True, None, None), (3, False, None, None)]
    pairs = spark.createDataFrame([(1, "A", "v1", "v2"), (2, "A", "v1", "x"), (3, "A", "y", "x"), (4, "C", "v1", "v2"), (5, "A", "v1", "v1")], "query_id int, document_id string, version_a string, version_b string")
    found = {}
    for r in reads.version_differences(pairs, docs, versions).orderBy("query_id").collect():
        found.setdefault(r["query_id"], []).append((r["error"], r["field"], r["old_value"], r["new_value"]))
    assert sorted(found[1]) == [(None, "file_sha256", "h1", "h2"), (None, "is_current", "false", "true"), (None, "published_at", "2020-01-01", "2021-01-01")]
    assert [found[k][0][0] for k in (2, 3, 4, 5)] == ["Version 'x' not found", "Versions 'y' and 'x' not found", "document not found", None]


def test_fixtures_are_run(spark, chunks):
    fields = "fixture_id int, query string, document_id string, language string, tags array<string>, tool string, expected_answerability string, expected_min_results int, expected_document_id string"
    rows = [(1, "duties", None, None, ["t"], None, "exact", 1, "A"), (2, "other", None, "en", ["t"], "search", "exact", 1, "B"), (3, "nothing here", None, None, ["t"], None, "no_match", None, None), (4, "first", None, "fr", ["t"], None, "exact", 1, "A"), (5, "scope", None, None, ["u"], None, None, None, None), (6, "x", None, None, ["t"], "status", None, None, None)]
    got = {r["fixture_id"]: r["passed"] for r in reads.run_fixtures(spark.createDataFrame(rows, fields), chunks, F.lit(False), tags=["t"]).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 6: False}
    rates = evaluate.pass_rates(spark.createDataFrame(list(got.items()), "k int, passed boolean").withColumn("all", F.lit("all")), ["all"]).first()
    assert tuple(rates) == ("all", 5, 3, 0.6)


def test_modes_are_compared(spark):
    fixtures = spark.createDataFrame([(1, ["A"], None), (2, None, ["4.1"]), (3, ["Z"], [])], "query_id int, expected_documents array<string>, expected_refs array<string>")
    hits = spark.createDataFrame([("keyword", 1, 2, "A", None), ("keyword", 1, 1, "B", None), ("hybrid", 1, 1, "A", None), ("hybrid", 2, 4, "B", "4.1"), ("keyword", 3, 1, "A", None)], "mode string, query_id int, rank int, document_id string, paragraph_ref string")
    got = {r["mode"]: (round(r["mrr"], 4), round(r["recall"], 4), r["queries"]) for r in evaluate.compare_modes(fixtures, hits, 3).collect()}
    assert got == {"keyword": (0.1667, 0.3333, 3), "hybrid": (0.4167, 0.3333, 3)}


def test_boilerplate_is_cleared(spark):
    rows = [
        (1, "a", "4", "Feedback on  the paper", "p", 1, None, 1.0, "t"), (1, "b", "4.1", "Title", "p", 2, "4", None, "t"), (1, "c", None, "Public consultation", "p", 1, "9", 0.9, "t"), (1, "d", "5", None, "Summary of responses", 1, None, 0.9, "t"),
        (1, "e", "6", "Title", "p", 1, "5", 0.5, "t"), (1, "f", "7", "Title", "p", 1, None, 0.9, "Do you have any comments?\nx"), (2, "g", "8", "Title", "p", 2, "4.1", 0.99, "t"), (1, "h", "4.2", "Title", "p", 2, "4.1", 0.99, None),
    ]
    df = spark.createDataFrame(rows, "version_id int, chunk_id string, section_ref string, section_title string, section_path string, section_level int, parent_section_ref string, metadata_confidence double, text string")
    got = {r["chunk_id"]: (r["section_ref"], r["section_path"], r["parent_section_ref"], r["metadata_confidence"]) for r in navigate.sanitize_sections(df, navigate.is_boilerplate()).collect()}
    assert got == {
        "a": (None, "", None, 1.0), "b": ("4.1", "p", None, 0.85), "c": (None, "p", "9", 0.9), "d": (None, "", None, 0.9), "e": ("6", "p", None, 0.5), "f": (None, "", None, 0.9), "g": ("8", "p", None, 0.85), "h": ("4.2", "p", "4.1", 0.99),
    }


def test_failures_are_counted(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "chunk_id string, check string")
    assert {tuple(r) for r in evaluate.failure_counts(rows).collect()} == {("x", 2), ("y", 1)}


def test_citations_are_projected(spark):
    rows = [("c1", "D", "one\ntwo three", "4.1", None, 0, 2, "paragraph"), ("c2", "D", "short", "", "4. Scope", 3, None, None), ("c3", "D", "", None, "", None, None, "table")]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, text string, paragraph_ref string, section_path string, page_start int, page_end int, chunk_type string")
    hits = spark.createDataFrame([(1, i, f"c{i}") for i in (1, 2, 3)], "query_id int, rank int, chunk_id string")
    got = [tuple(r)[2:] for r in reads.citations(hits, chunks, 7).orderBy("rank").collect()]
    assert got == [
        ("c1", "D", "4.1", "", None, 2, "one two", True, "7 / 13", "D, para. 4.1", "paragraph"), ("c2", "D", None, "4. Scope", 3, None, "short", False, None, 'D, section "4. Scope", p. 3', None),
        ("c3", "D", None, "", None, None, "", False, None, 'D, section ""', "table"),
    ]


def test_enrichment_of_first_pages(spark):
    pages = spark.createDataFrame([("AB-GL-2021-05", 2, "and ab/gl/2021/05 itself"), ("AB-GL-2021-05", 1, "See AB-GL-2019-01,\nwhich will apply from 3 March 2022."), ("AB-GL-2021-05", 11, "CD/RTS/2000/1"), ("b", 1, "applicable as of Sept 2020"), ("c", 1, "applies since 2020-02-30x; apply from 1 May 2021")], "document_id string, page_no int, text string")
    docs = spark.createDataFrame([("AB-GL-2021-05", "Guidelines amending others"), ("b", None), ("c", "t"), ("none", "t")], "document_id string, title string")
    told, edges = corpus.enrich(pages, docs)
    assert {r["document_id"]: r["application_date"] for r in told.collect()} == {"AB-GL-2021-05": "2022-03-03", "b": None, "c": "2020-02-30", "none": None}
    assert [tuple(r) for r in edges.collect()] == [("AB-GL-2021-05", "AB/GL/2019/01", "amends", "medium")]
    dates = spark.createDataFrame([("apply from may 2021",), ("Applies with effect from 45 May 2021",), ("applicable from Dec 2020",), ("nothing",), (None,)], "t string")
    assert [r[0] for r in dates.select(text.application_date(F.col("t"))).collect()] == ["2021-05-01", None, "2020-12-01", None, None]
