from pyspark.sql import functions as F

from quillspark.core import materialize
from quillspark.operators import keyword_index, navigate, search
from quillspark.operators.evaluate import cyclic_sections, judge_fixtures
from quillspark.plans import build
from quillspark.plans.retrieve import COMPACT, compact, index_chunks, search_chunks, sections, split_requests, vectors_unfit, with_flags
from quillspark.sources.snapshots import SnapshotTable

CHUNK = "chunk_id string, document_id string, sequence_no int, document_region string, text string"


def test_vectors_that_fit():
    fit = {"embedding_model": "m", "embedding_dim": 3}
    assert vectors_unfit(fit, "m", 3) is None and vectors_unfit(fit, "m", None) is None
    assert all(vectors_unfit(*x) for x in ((None, "m", 3), ({"embedding_model": "m"}, "m", 3), (fit, "other", 3), (fit, "m", 4)))


def test_requests_take_their_path(spark):
    rows = [(1, " X/GL/2020/01 ", None), (2, "  ", "X/GL/2020/02"), (3, "some words", "X/GL/2020/01"), (4, None, None), (5, "x/op/2021/7", None)]
    requests = spark.createDataFrame(rows, "query_id int, query string, document_id string")
    aliases = spark.createDataFrame([("X/GL/2020/02", "X/GL/2022/09")], "target string, source string")
    ids, words = split_requests(requests, F.trim("query").rlike(r"(?i)^[A-Z]{1,6}/[A-Za-z]+/\d{4}/\d+$"), aliases)
    assert {tuple(r) for r in ids.collect()} == {(1, "X/GL/2020/01"), (2, "X/GL/2022/09"), (5, "x/op/2021/7")}
    assert [tuple(r) for r in words.collect()] == [(3, "some words", "X/GL/2020/01")]


def test_search_modes_and_regions(spark):
    chunks = spark.createDataFrame([("a1", "A/GL/2020/1", 1, "front_matter", "risk risk"), ("a2", "A/GL/2020/1", 2, "body", "risk factors"), ("b1", "B/GL/2020/2", 1, "body", "other words")], CHUNK)
    requests = spark.createDataFrame([(1, "A/GL/2020/1", None), (2, "risk", None), (3, "risk words", None), (4, "risk", "B/GL/2020/2"), (5, "AND", None)], "query_id int, query string, document_id string")
    is_id = F.col("query").rlike("^[A-Z]+/GL/")
    got = {}
    for r in search_chunks(requests, chunks, is_id, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["mode"]))
    assert set(got) == {1, 2, 3} and got[1] == [("a2", "exact"), ("a1", "exact")] and got[2] == [("a2", "and"), ("a1", "and")]
    assert len(got[3]) == 2 and {mode for _, mode in got[3]} == {"or"}
    vectors = spark.createDataFrame([("a2", [1.0, 0.0]), ("b1", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(2, [0.1, 1.0])], "query_id int, embedding array<double>")
    hybrid = search_chunks(requests.where("query_id IN (2, 3)"), chunks.where("chunk_id <> 'a1'"), is_id, 2, vectors=vectors, asked_vectors=asked)
    assert {(r["query_id"], r["chunk_id"]) for r in hybrid.collect()} == {(2, "a2"), (2, "b1"), (3, "a2"), (3, "b1")}


def test_sections_by_outline_or_prefix(spark):
    rows = [(v, f"{v}-{i}", i, ref, path, "body") for v in (1, 2) for i, (ref, path) in enumerate([("4", "4. Scope"), ("4.1", "x"), ("41", "y"), (None, "4. Scope of it")])]
    chunks = spark.createDataFrame(rows, "version_id int, chunk_id string, sequence_no int, paragraph_ref string, section_path string, document_region string")
    outline = spark.createDataFrame([(1, "4", 1, 2)], "version_id int, section_ref string, sequence_start int, sequence_end int")
    asked = spark.createDataFrame([(1, 1, "4."), (2, 2, "4")], "query_id int, version_id int, section string")
    got = sorted((r["query_id"], r["origin"], r["chunk_id"]) for r in sections(asked, chunks, outline).collect())
    assert got == [(1, "stored", "1-1"), (1, "stored", "1-2"), (2, "prefix", "2-0"), (2, "prefix", "2-1"), (2, "prefix", "2-3")]


def test_cycles_through_parents(spark):
    refs = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "d", "a"), (1, "e", "f"), (2, "a", "b"), (1, "s", "s")], "r_version int, r_ref string, r_parent string")
    assert {(r["r_version"], r["r_ref"]) for r in cyclic_sections(refs).where("cyclic").collect()} == {(1, x) for x in "abcds"}


def test_flags_and_compact_citations(spark):
    rows = spark.createDataFrame([("a", "4.1", "4.1"), ("a:sub2", "4.2", "4.1"), ("b", None, "4.1")], "chunk_id string, paragraph_ref string, requested_ref string")
    assert [(r["is_anchor"], r["is_complete"]) for r in with_flags(rows).orderBy("chunk_id").collect()] == [(True, True), (False, False), (False, True)]
    wide = spark.range(1).select("id", *(F.lit("x").alias(c) for c in (*COMPACT, "section_path", "chunk_type")))
    assert compact(wide, "id").columns == ["id", *COMPACT]


def test_fixtures_are_judged(spark):
    rows = [(1, None, None, None, None), (2, "search", "no_match", None, None), (3, "search", "exact", 2, "D"), (4, "search", None, 3, "E"), (5, "status", None, None, None), (6, None, None, None, None), (7, None, "no_match", None, None)]
    fixtures = spark.createDataFrame(rows, "fixture_id int, tool string, expected_answerability string, expected_min_results int, expected_document_id string")
    answers = spark.createDataFrame([(1, "partial"), (2, "no_match"), (3, "exact"), (4, "exact"), (5, "anything"), (7, "no_match")], "fixture_id int, answerability string")
    cited = spark.createDataFrame([(1, "A"), (3, "D"), (3, None), (4, "D"), (7, "A")], "fixture_id int, document_id string")
    got = {r["fixture_id"]: (r["passed"], r["reasons"]) for r in judge_fixtures(fixtures, answers, cited, ("document_id",)).collect()}
    assert [k for k in got if got[k][0]] and {k for k in got if got[k][0]} == {1, 2, 3, 5}
    assert got[4][1] == ["expected answerability partial, got exact", "expected at least 3 results, got 1", "expected document E not in results"]
    assert "no answer" in got[6][1] and got[7][1] == ["expected zero citations"]
    assert {r["fixture_id"] for r in judge_fixtures(fixtures, answers, cited).where("passed").collect()} == {2, 5}


def wide_chunks(spark):
    rows = [
        ("c1", "A/GL/2020/1", 1, "body", "Scope of risk", "4. Scope", "4", "risk appetite statement", "Risk", "guideline", "en"),
        ("c2", "A/GL/2020/1", 2, "body", "Scope of risk", "Feedback on the public consultation", "5", "risk feedback", "Risk", "guideline", "en"),
        ("c3", "B/OP/2021/2", 1, "body", "Opinion on money laundering", "1. Général", "1", "opinion text", "Opinions", "opinion", "fr"),
        ("c4", "C/GL/2022/3", 1, "body", "Other", None, None, "risk appetite statement again", None, "guideline", "en"),
    ]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, sequence_no int, document_region string, title string, section_path string, paragraph_ref string, text string, topic string, document_type string, language string")


def test_all_columns_and_filters(spark):
    chunks = wide_chunks(spark)
    index = materialize(index_chunks(chunks), "index")
    fields = "query_id int, query string, document_id string, language string, topic string, document_type string, exclude_consultation boolean"
    requests = [
        (1, "risk", None, None, None, None, None), (2, "risk", None, None, None, None, True), (3, "risk", "C/GL/2022/3", None, None, None, None), (4, "opinion", None, "en", None, None, None), (5, "opinion general", None, "fr", None, None, None),
        (6, "opinion", None, None, "aml/cft", None, None), (7, "risk", None, "", "Risk", "guideline", False), (8, "guideline statement", None, None, None, None, None), (9, "A/GL/2020/1", None, None, None, None, True), (10, "A/GL/2020/1", None, "fr", None, None, None),
        (11, "GL 2022", None, None, None, None, None), (12, "risk", "none", None, None, None, None),
    ]
    got = {}
    for r in search_chunks(spark.createDataFrame(requests, fields), chunks, F.col("query").rlike("^[A-Z]+/GL/"), 10, index=index).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert {k: sorted(v) for k, v in got.items()} == {1: ["c1", "c2", "c4"], 2: ["c1", "c4"], 3: ["c4"], 5: ["c3"], 6: ["c3"], 7: ["c1", "c2"], 8: ["c1", "c4"], 9: ["c1"], 11: ["c4"]}


def test_an_index_grows_by_appending(spark, tmp_path):
    chunks = wide_chunks(spark)
    at = SnapshotTable(spark, f"file://{tmp_path}/index")
    for i, doc in enumerate(("A", "B", "C")):
        at.append(index_chunks(chunks.where(F.startswith("document_id", F.lit(doc))), name=f"part{i}-"))
    whole = materialize(index_chunks(chunks), "index")
    asked = spark.createDataFrame([(1, "risk"), (1, "appetite"), (2, "opinion"), (2, "and"), (3, "and"), (4, "statement"), (4, "unknown")], "query_id int, term string")
    rows = lambda index: sorted(tuple(r) for r in search.keyword_hits(index, asked, 10).collect())
    assert rows(at.read()) == rows(whole)
    assert {(r[0], r[3]) for r in rows(whole)} == {(1, "and"), (2, "and"), (4, "or")}


def test_generated_ids_go_behind_and_unfit_vectors_stay_unused(spark):
    text = " ".join(f"word{i:03d}" for i in range(40))
    rows = [("a", "X/LARGE-GL/0000/0001", 1, "body", "4", text), ("b", "X/GL/2021/01", 1, "body", "4", text.upper() + " more"), ("c", "X/LARGE-GL/0000/0002", 1, "body", "5", text)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, sequence_no int, document_region string, paragraph_ref string, text string")
    requests = spark.createDataFrame([(1, "word001 word002", None), (2, "word001", "X/LARGE-GL/0000/0001")], "query_id int, query string, document_id string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0])], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    found = search_chunks(requests, chunks, F.lit(False), 10, vectors=vectors, asked_vectors=asked, manifest={"embedding_model": "m", "embedding_dim": 3}, model="m", dim=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["chunk_id"], r["mode"]) for r in found] == [(1, "b", "and"), (1, "c", "and"), (1, "a", "and"), (2, "a", "and")]
    assert all("dimensions" in r["warning"] for r in found)


def test_few_terms_are_pushed_to_the_scan(spark, tmp_path):
    at = SnapshotTable(spark, f"file://{tmp_path}/index")
    at.replace(build.by_term(index_chunks(wide_chunks(spark))))
    terms = spark.createDataFrame([("risk",)], "term string")
    plan = keyword_index.term_counts(at.read(), terms)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "risk" in plan


def test_sections_by_language(spark):
    rows = [(1, f"c{i}", i, "4.1", "x", "body", lang, "en") for i, lang in enumerate(["en", "fr", "en"])] + [(2, "d0", 0, "4.1", "x", "body", "fr", "en")]
    chunks = spark.createDataFrame(rows, "version_id int, chunk_id string, sequence_no int, paragraph_ref string, section_path string, document_region string, language string, document_language string")
    outline = spark.createDataFrame([(1, "4.1", 0, 1), (2, "4.1", 0, 0)], "version_id int, section_ref string, sequence_start int, sequence_end int")
    asked = spark.createDataFrame([(1, 1, "4", None), (2, 1, "4", "fr"), (3, 2, "4", "fr")], "query_id int, version_id int, section string, language string")
    got = sorted((r["query_id"], r["origin"], r["chunk_id"]) for r in sections(asked, chunks, outline).collect())
    # the document is English: French requests are answered by prefixes
    assert got == [(1, "stored", "c0"), (2, "prefix", "c1"), (3, "prefix", "d0")]


def test_outline_of_all_regions(spark):
    rows = [(1, 1, "1", "Scope", "front_matter"), (1, 2, "2", "Duties", "body"), (1, 3, "", "none", "body")]
    df = spark.createDataFrame(rows, "version_id int, sequence_no int, section_ref string, section_title string, document_region string").selectExpr("*", "1 AS section_level", "null AS parent_section_ref", "1.0 AS metadata_confidence", "1 AS page_start", "1 AS page_end")
    assert {r["section_ref"] for r in navigate.outline(df).collect()} == {"2"}
    assert {r["section_ref"] for r in navigate.outline(df.drop("document_region"), regions=None).collect()} == {"1", "2"}
