import pickle
import random

from quillspark.operators import segment
from quillspark.operators.segment import fold_outline, heuristic_outline, paragraph_ref, paragraphize, paragraphs, split_long, split_text


def by_ref(chunks):
    return {c["paragraph_ref"]: c for c in chunks}


def test_equal_text_on_two_pages_has_two_ids():
    got = paragraphs("doc", "en", [(1, "4. Quality of controls"), (2, "4. Quality of controls")])
    assert [c["paragraph_ref"] for c in got] == ["4", "4"]
    assert [c["chunk_id"][-6:] for c in got] == [":p1:s0", ":p2:s1"]
    assert len({c["chunk_id"] for c in got}) == 2


def test_transition_between_sections():
    page = "4. General provisions\n4.1 Business-wide risk assessment\n4.1.5 Risk factors\nA body line about risk.\n4.2 Individual risk assessments\n" + "88. " + "A long paragraph that goes on about many things and is no heading at all " * 3
    got = by_ref(paragraphs("doc", "en", [(1, "x"), (2, "y"), (3, "z"), (4, page)]))
    assert (got["4.2"]["section_ref"], got["4.2"]["parent_section_ref"], got["4.2"]["section_level"]) == ("4.2", "4", 2)
    assert got["88"]["section_ref"] == "4.2" and "4.1.5" not in got["88"]["section_path"]
    assert got["4.1.5"]["text"].endswith("A body line about risk.")


def test_long_paragraph_is_no_section():
    page = "4.1.5 Risk factors\n87. " + "Firms should consider all of these risk factors in the light of what they know about it " * 3
    got = by_ref(paragraphs("doc", "en", [(8, page)]))
    assert (got["87"]["chunk_type"], got["87"]["section_ref"]) == ("paragraph", "4.1.5")
    assert got["4.1.5"]["metadata_confidence"] == 0.85  # its parent is missing


def test_front_matter_and_noise():
    got = paragraphs("doc", "en", [(1, "Some report\nRunning head"), (4, "Running head\n1. Subject matter\n2\nText of it")], {"Running head"})
    assert got[0]["document_region"] == "front_matter" and got[0]["section_ref"] is None
    assert got[1]["text"] == "1. Subject matter\nText of it" and got[1]["document_region"] == "body"
    assert paragraphs("doc", "en", []) == [] and paragraphs("doc", "en", [(1, None)]) == []


def test_references():
    assert [paragraph_ref(x) for x in ("4.1 a", "12. b", "1000 c", "2024. d", "4.1", "x")] == ["4.1", "12", None, None, None, None]
    assert paragraph_ref("4.2.", bare=True) == "4.2"


def test_split():
    assert split_text("short") == ["short"]
    text = "\n".join(f"{i}. item " + "x" * 40 for i in range(60))
    parts = split_text(text, 500)
    assert all(0 < len(p) <= 500 for p in parts) and "\n".join(parts) == text
    assert split_text("y" * 1200, 500) == ["y" * 500, "y" * 500, "y" * 200]


def test_split_long_is_dense(spark):
    rows = spark.createDataFrame([("d", "a", 0, "short"), ("d", "b", 1, "z" * 90), ("e", "c", 0, None)], "document_id string, chunk_id string, sequence_no int, text string")
    got = {r["chunk_id"]: r["sequence_no"] for r in split_long(rows, 40).collect()}
    assert got == {"a": 1, "b:sub0": 2, "b:sub1": 3, "b:sub2": 4, "c": 1}


def test_outline_fold():
    rows = [(1, "4. Legacy Derived Title", "4.1", "4. Legacy Derived Title", None, None)]
    got = fold_outline(rows)
    assert [(x["section_ref"], x["level"], x["confidence"], x["refs"]) for x in got] == [("4", 1, "high", ["4.1"])]
    rows = [(1, "1. Early", "1", "t", 1, 1), (12, "Guidelines", None, "t", 2, 2), (13, "2. Scope", "2", "t", 3, 3), (14, "feedback on it", None, "t", 4, 4), (15, "3. Next", "3", "t", 5, 6), (40, "2. Scope", "9", "t", 9, 9)]
    assert [(x["section_ref"], x["last_seq"]) for x in fold_outline(rows)] == [("2", 13), ("3", 15)]


def test_outline_by_version(spark):
    rows = spark.createDataFrame([(1, 1, "1. Scope", None, "t", 2, None), (1, 2, "1. Scope", "7", "t", 1, 5), (2, 1, None, None, "t", None, None)], "version_id int, sequence_no int, section_path string, paragraph_ref string, text string, page_start int, page_end int")
    got = [(r["version_id"], r["section_ref"], r["page_start"], r["page_end"], r["chunk_count"]) for r in heuristic_outline(rows).collect()]
    assert got == [(1, "1", 1, 5, 2)]


LINES = ["4. General provisions", "4.1 Business-wide risk", "4.1.5 Risk factors", "4.2.", "87. " + "Firms should consider all of it " * 6, "Contents", "a body line", "Annex I", "12", "feedback on it", "ABC/GL/2020/01", "Short heading", "Article 3", ""]


def random_pages(seed, n):
    r = random.Random(seed)
    return [(i, "\n".join(r.choice(LINES) + r.choice(["", " x"]) for _ in range(r.randrange(0, 9)))) for i in range(1, n + 1)]


def test_table_functions_in_sql(spark):
    docs = {f"d{k}": random_pages(k, 12) for k in range(6)}
    rows = spark.createDataFrame([(d, "en", p, t) for d, ps in docs.items() for p, t in ps], "document_id string, language string, page_no int, text string")
    noise = spark.createDataFrame([("d1", "a body line"), ("d2", "Contents")], "document_id string, line string")
    drop = {"d1": {"a body line"}, "d2": {"Contents"}}
    want = [(d, *(c[n] for n in segment.CHUNK_COLUMNS)) for d, ps in docs.items() for c in paragraphs(d, "en", ps, drop.get(d, set()))]
    got = paragraphize(rows, noise=noise)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    segment.register(spark)
    rows.selectExpr("*", "12 AS pages", "array() AS noise").createOrReplaceTempView("some_pages")
    by_sql = spark.sql("SELECT * FROM paragraph_table(TABLE(some_pages) PARTITION BY document_id ORDER BY page_no)").where("document_id NOT IN ('d1', 'd2')")
    assert sorted(map(repr, map(tuple, by_sql.collect()))) == sorted(repr(w) for w in want if w[0] not in drop)
    got.selectExpr("document_id AS version_id", "*").createOrReplaceTempView("some_chunks")
    outline = spark.sql("SELECT * FROM outline_table(TABLE(some_chunks) PARTITION BY version_id ORDER BY sequence_no)").collect()
    one = sorted((r for r in want if r[0] == "d3"), key=lambda r: r[2])
    at = {n: i + 1 for i, n in enumerate(segment.CHUNK_COLUMNS)}
    folded = fold_outline([(r[at["sequence_no"]], r[at["section_path"]], r[at["paragraph_ref"]], r[at["text"]], r[at["page_start"]], r[at["page_end"]]) for r in one])
    assert [tuple(r)[1:] for r in sorted((r for r in outline if r["version_id"] == "d3"), key=lambda r: r["first_seq"])] == [tuple(x[c] for c in segment.OUTLINE_COLUMNS) for x in folded]


def test_a_million_lines_in_flat_memory():
    page = "\n".join(f"{i}. item number {i} of the page" if i % 5 == 0 else f"line {i} of some text that goes on" for i in range(1, 101))
    reader = segment.ParagraphReader("doc", "en", 10_000)
    n = 0
    for p in range(1, 10_001):
        n += sum(1 for _ in reader.feed(p, page))
        if p % 1000 == 0:  # all that it keeps
            assert len(pickle.dumps(reader)) < 20_000
    assert n + sum(1 for _ in reader.finish()) > 100_000
