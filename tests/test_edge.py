import json

import pytest

from quillspark.operators import embed
from quillspark.plans import api
from quillspark.sources import files


@pytest.mark.parametrize(
    "raw",
    [
        {"query": "x" * 501}, {"query": "   "}, {"query": 3}, {"query": "a", "limit": 999}, {"query": "a", "max_chars": 0}, {"query": "a", "max_chars": 1.5}, {"query": "a", "max_chars": 100001},
        {"query": "a", "max_citations": 51}, {"query": "a", "max_citations": 0}, {"query": "a", "search_mode": "x"}, {"query": "a", "other": 1}, {"query": "a", "filters": {"language": "fr"}},
        {"query": "a", "filters": {"topic": {"a": 1}}}, {"query": "a", "filters": {"topic": "a\x01"}}, {"query": "a", "filters": {"exclude_consultation_responses": "true"}},
    ],
)
def test_rejected(raw):
    with pytest.raises(api.InvalidRequest):
        api.parse_search(raw)


def test_accepted():
    got = api.parse_search({"query": "  a'; DROP \n TABLE x -- * OR ", "response_mode": "brief"})
    assert (got.query, got.limit, got.max_chars, got.max_citations, got.exact_id) == ("a'; DROP TABLE x -- * OR", 10, 600, 15, False)
    assert api.parse_search({"query": "ABC/GL/2023/03"}).exact_id
    assert api.parse_paragraph({"paragraph_refs": ["4.1", "7"]}) == ["4.1", "7"]
    for raw in ({}, {"paragraph_refs": ["1"] * 21}, {"paragraph_ref": "4(1)"}):
        with pytest.raises(api.InvalidRequest):
            api.parse_paragraph(raw)


def test_requests_of_other_kinds():
    assert api.parse_paragraph({"paragraph_ref": "Title I"}) == ["Title I"]
    assert api.parse_request("section", {"document_id": "ABC/GL/2021/02", "section": " 4.  Scope"}) == {"document_id": "ABC/GL/2021/02", "section": "4. Scope", "language": "en", "limit": 200, "max_chars": None}
    assert api.parse_request("list", {"filters": {"topic": "AML/CFT"}}) == {"filters": {"topic": "AML/CFT"}, "limit": 20}
    assert api.parse_request("corpus", None) == {} and api.parse_request("citation", {"citation_id": "a:b-1"})["citation_id"] == "a:b-1"
    one = {"document_id": "ABC/GL/2021/02"}
    wrong = [("corpus", one), ("citation", {}), ("citation", {"chunk_id": "-a"}), ("status", {}), ("versions", {"document_id": "GL/1"}), ("difference", one | {"version_a": "1"}), ("difference", one | {"version_a": "1", "version_b": "x" * 101})]
    wrong += [("document", one | {"language": "fr"}), ("outline", one | {"limit": 301}), ("list", {"filters": {"document_id": "ABC/GL/2021/02"}}), ("section", one | {"section": "(4)"})]
    for kind, raw in wrong:
        with pytest.raises(api.InvalidRequest):
            api.parse_request(kind, raw)


def test_budget():
    small = api.envelope([{"text": "a"}], "exact")
    assert api.within_budget(small) == small
    got = api.within_budget(api.envelope([{"text": "é" * 30_000}, {"text": "b" * 30_000}], "partial"))
    assert len(got["citations"]) == 1 and len(json.dumps(got, ensure_ascii=False)) <= api.BUDGET
    got = api.within_budget(api.envelope([{"text": "c" * 90_000}], "partial"))
    assert len(got["citations"][0]["text"]) == 200


def test_embedding_batches():
    calls = []

    def service(texts):
        calls.append(list(texts))
        if len(calls) == 1:
            raise OSError("down")
        if len(texts) > 1:
            raise TimeoutError
        return [[1.0, 0.0]]

    assert embed.embed_texts(["a", "b", "c"], service, 2, batch=2, sleep=lambda s: None) == [[1.0, 0.0]] * 3
    assert [c for c in calls if len(c) == 1] == [["a"], ["b"], ["c"]]
    for bad, said in (([[1.0]], "dimensions"), ([[2.0, 0.0]], "norm"), ([], "gave"), ([[float("nan"), 0.0]], "finite")):
        with pytest.raises(embed.EmbeddingError, match=said):
            embed.checked(bad, 1, 2)


def test_embed_missing(spark):
    chunks = spark.createDataFrame([("1", "a"), ("2", None), ("3", "c")], "chunk_id string, text string")
    got = embed.embed_missing(chunks, chunks.where("chunk_id = '1'"), lambda t: [[1.0, 0.0] for _ in t], 2).collect()
    assert sorted(r["chunk_id"] for r in got) == ["2", "3"]


def test_repair(spark):
    rows = spark.createDataFrame(
        [("d", "1-0", 1, "4. Scope of it", None, None, "body", "deterministic"), ("d", None, 2, "sure", "1", "One", "body", "deterministic")],
        "document_id string, span string, sequence_no int, text string, section_ref string, section_title string, document_region string, metadata_source string",
    )
    good = json.dumps({"sections": [{"sequence_no": 1, "section_ref": "4", "title": "Scope of it"}], "regions": []})
    got = {r["sequence_no"]: (r["section_ref"], r["metadata_source"]) for r in embed.repair_spans(rows, lambda s: good).collect()}
    assert got == {1: ("4", "llm_repair"), 2: ("1", "deterministic")}
    for bad in ("no json", json.dumps({"sections": [], "regions": [], "more": 1}), good.replace("Scope of it", "Not there")):
        got = {r["sequence_no"]: r["metadata_source"] for r in embed.repair_spans(rows, lambda s, b=bad: b).collect()}
        assert got == {1: "deterministic", 2: "deterministic"}


def test_files(spark, tmp_path):
    (tmp_path / "doc-a").mkdir()
    (tmp_path / "doc-a/pages.json").write_text(json.dumps([{"page_no": 1, "text": "t", "extraction_method": "m", "char_count": 1}]))
    assert [(r["slug"], r["page_no"]) for r in files.read_pages(spark, f"{tmp_path}/*/pages.json").collect()] == [("doc-a", 1)]
    rows = spark.createDataFrame([tuple(["u", "s1"] + [None] * 8), tuple(["v", "s1"] + [None] * 8)], files.DOWNLOAD)
    for _ in range(2):
        files.append_manifest(rows, f"{tmp_path}/manifest")
    assert files.read_manifest(spark, f"{tmp_path}/manifest").count() == 1
    (tmp_path / "env").write_text("DB_PATH=./x.db\n")
    assert files.setting("DB_PATH", None, str(tmp_path / "env"), "d") == str(tmp_path / "x.db")
    assert files.setting("DB_PATH", "given", str(tmp_path / "env"), "d") == "given"


def test_streaming_ingest(spark, tmp_path):
    from quillspark.streaming.ingest import ingest_documents

    spark.createDataFrame([(1, "en", "s", "a\n\nb")], "document_id long, language string, topic string, text string").write.parquet(f"{tmp_path}/in")
    ingest_documents(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    assert [r["text"] for r in spark.read.parquet(f"{tmp_path}/out").orderBy("sequence_no").collect()] == ["a", "b"]


def test_vectors_are_committed_by_part(spark, tmp_path):
    chunks = spark.createDataFrame([(i, "bad" if i == 7 else "t") for i in range(20)], "chunk_id int, text string")
    path = str(tmp_path / "vectors")

    def fails(texts):
        if "bad" in texts:
            raise ValueError("service")
        return [[1.0, 0.0] for _ in texts]

    with pytest.raises(Exception, match="service"):
        embed.append_vectors(chunks, path, fails, 2, parts=4)
    before = spark.read.parquet(path).count()
    assert before < 20
    embed.append_vectors(chunks, path, lambda t: [[1.0, 0.0] for _ in t], 2, parts=4)
    assert sorted(int(r["chunk_id"]) for r in spark.read.parquet(path).collect()) == list(range(20))


def test_versions_are_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/outline"

    def put(rows, versions):
        got = files.replace_versions(spark.createDataFrame(rows, "version_id int, section_ref string"), spark.createDataFrame([(v,) for v in versions], "version_id int"), path)
        return {(r["version_id"], r["section_ref"]) for r in got.collect()}

    first = {(v, str(k)) for v in range(6) for k in range(3)}
    assert put(sorted(first), range(6)) == first
    kept = {x for x in first if x[0] not in (1, 2)}
    assert put([(1, "new")], [1, 2]) == kept | {(1, "new")}
    assert put([(9, "a")], [v for v in range(6)]) == {(9, "a")}


def test_reports_seeds_and_defaults(spark, tmp_path):
    reports = lambda rows: spark.createDataFrame(rows, "slug string, passed boolean")
    files.write_reports(reports([("a", True), ("b", False)]), f"file://{tmp_path}/reports")
    got = files.write_reports(reports([("b", True), ("c", False)]), f"file://{tmp_path}/reports")
    assert {tuple(r) for r in got.collect()} == {("a", True), ("b", True), ("c", False)}
    (tmp_path / "seeds.yaml").write_text("documents:\n- document_id: A/GL/2020/1\n  title: one\n- title: 2\n")
    (tmp_path / "none.yaml").write_text("")
    assert [(r["document_id"], r["title"]) for r in files.read_seeds(spark, f"file://{tmp_path}/seeds.yaml").collect()] == [("A/GL/2020/1", "one"), (None, "2")]
    assert files.read_seeds(spark, f"file://{tmp_path}/none.yaml").count() == 0
    df = spark.createDataFrame([(1, None), (2, "x")], "k int, lang string")
    assert [tuple(r) for r in files.with_defaults(df, {"lang": "en", "note": None}, {"lang": "string", "note": "string"}).orderBy("k").collect()] == [(1, "en", None), (2, "x", None)]
    (tmp_path / "a.bin").write_bytes(b"abc")
    assert [r["length"] for r in files.read_binary(spark, f"file://{tmp_path}/*.bin", ("/a.",)).collect()] == [3]
    assert files.read_binary(spark, f"file://{tmp_path}/*.bin", ("/z.",)).count() == 0


def test_settings(tmp_path, monkeypatch):
    env = tmp_path / ".env"
    env.write_text("# none\nSOME_PATH='data/x.db'\nSOME_MODE=hybrid\n")
    assert files.setting("SOME_PATH", None, str(env), "d", path=True) == str(tmp_path / "data/x.db")
    assert files.setting("SOME_MODE", None, str(env), "d") == "hybrid" and files.setting("OTHER", None, str(env), "d") == "d"
    monkeypatch.setenv("SOME_MODE", "keyword")
    assert files.setting("SOME_MODE", None, str(env), "d") == "keyword" and files.setting("SOME_MODE", "given", str(env), "d") == "given"
