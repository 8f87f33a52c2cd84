"""Composed reads of whole tables of requests: documents, paragraphs, outlines, versions, differences, citations.

A request names a document by an id that may be an alias; ``resolved`` finds the id that
stands for it, fixed overrides before edges. Every read says how it went, so a
request without an answer keeps a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.core import materialize
from quillspark.functions import text as X
from quillspark.operators import budget, evaluate, navigate, search, segment
from quillspark.plans import retrieve

#: Chunks that a document's read begins with, and how many it is chosen from.
LEADING, LEADING_OF = 5, 50
#: Columns of a citation whose JSON counts against a budget.
CITED = ("citation_id", "document_id", "paragraph_ref", "section_path", "page_start", "page_end", "text", "truncated", "truncation_offset", "citation", "chunk_type")


def resolved(requests: DataFrame, aliases: DataFrame, overrides: dict[str, str] | None = None, column: str = "document_id") -> DataFrame:
    """Adds ``requested_id`` and ``alias_note``; ``column`` is the id that stands for it, one hop away.

    ``aliases``: target, source. An override wins over an edge, and is itself not followed.
    """
    rows = requests.withColumn("requested_id", F.col(column).cast("string"))
    edges = aliases.select(F.col("target").cast("string").alias("a_target"), F.col("source").cast("string").alias("a_source"))
    fixed = F.create_map(*(F.lit(x) for pair in (overrides or {"": ""}).items() for x in pair))
    rows = rows.join(edges, F.col("requested_id") == F.col("a_target"), "left")
    ident = F.coalesce(F.try_element_at(fixed, F.col("requested_id")), "a_source", "requested_id")
    rows = rows.withColumn(column, ident).drop("a_target", "a_source")
    note = F.when(F.col(column) != F.col("requested_id"), F.concat("requested_id", F.lit(" resolved to "), column))
    return rows.withColumn("alias_note", note)


def document_heads(requests: DataFrame, chunks: DataFrame, most: int = LEADING) -> DataFrame:
    """(query_id, chunk_id, place): the chunks that a document's read begins with, body regions first.

    ``requests``: query_id, document_id; ``chunks``: document_id, chunk_id, sequence_no,
    document_region.
    """
    rows = requests.select("query_id", F.col("document_id").cast("string").alias("d")).join(chunks.select(F.col("document_id").cast("string").alias("d"), "chunk_id", "sequence_no", "document_region"), "d")
    first = search.ranked(rows, [F.col("sequence_no"), F.col("chunk_id")], retrieve.overfetch(LEADING_OF))
    return search.prefer_regions(first).where(F.col("rank") <= most).select("query_id", "chunk_id", F.col("rank").alias("place"))


def paragraphs(requests: DataFrame, chunks: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """(query_id, chunk_id, place, is_anchor, is_complete): paragraphs by reference, each with its neighbours.

    ``requests``: query_id, document_id, paragraph_ref, language; several references of a
    query in the order of ``ref_no`` if that is given. ``chunks``: document_id, version_id,
    language, chunk_id, sequence_no, paragraph_ref. Matches come in sequence order, each
    among its neighbours of the same version, whatever their language; a chunk is given where it
    first comes up. ``is_anchor``: its reference is one that was asked for.
    """
    ref_no = F.col("ref_no") if "ref_no" in requests.columns else F.lit(0)
    asked = requests.select("query_id", F.col("document_id").cast("string").alias("q_doc"), F.col("paragraph_ref").alias("q_ref"), F.coalesce("language", F.lit("en")).alias("q_lang"), ref_no.alias("ref_no"))
    rows = chunks.select(F.col("document_id").cast("string").alias("document_id"), "version_id", "language", "chunk_id", "sequence_no", "paragraph_ref")
    hit = (F.col("q_doc") == F.col("document_id")) & (F.col("q_ref") == F.col("paragraph_ref")) & (F.col("q_lang") == F.col("language"))
    found = asked.join(rows, hit).select("query_id", "ref_no", "q_ref", F.col("sequence_no").alias("m_seq"), F.col("version_id").alias("m_version"), F.col("chunk_id").alias("m_chunk"))
    around = rows.select("version_id", "chunk_id", "sequence_no", "paragraph_ref")
    near = found.join(around, (F.col("m_version") == F.col("version_id")) & F.col("sequence_no").between(F.col("m_seq") - before, F.col("m_seq") + after))
    order = ["ref_no", "m_seq", "m_chunk", "sequence_no", "chunk_id"]
    once = near.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(*order))).where("nth = 1")
    refs = asked.groupBy("query_id").agg(F.collect_set("q_ref").alias("refs"))  # as many as a request states
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).join(refs, "query_id")
    anchor = F.coalesce(F.array_contains("refs", F.col("paragraph_ref")), F.lit(False))
    return placed.select("query_id", "chunk_id", "place", anchor.alias("is_anchor"), (~F.contains("chunk_id", F.lit(":sub"))).alias("is_complete"))


def outlines(requests: DataFrame, versions: DataFrame, chunks: DataFrame, stored: DataFrame, limit: int = 200) -> DataFrame:
    """(query_id, version_id, origin, place, section_ref, title, level): a document's outline, stored if there is one, else folded from its chunks.

    ``requests``: query_id, document_id. Of a document's versions the current one counts, then
    the latest. ``origin``: stored or folded; a request without a version has no rows.
    """
    current = navigate.latest_version(versions).select(F.col("document_id").cast("string").alias("d"), "version_id")
    asked = materialize(requests.select("query_id", F.col("document_id").cast("string").alias("d")).join(current, "d").select("query_id", "version_id"), "outline-requests")
    kept = asked.join(stored, "version_id").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*navigate.outline_order())))
    kept = kept.select("query_id", "version_id", F.lit("stored").alias("origin"), "place", "section_ref", "title", F.col("level").cast("int").alias("level"))
    bare = asked.join(stored.select("version_id").distinct(), "version_id", "left_anti")
    folded = segment.heuristic_outline(chunks.join(bare.select("version_id").distinct(), "version_id", "left_semi"))
    folded = bare.join(folded, "version_id").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first_seq", "section_ref")))
    folded = folded.select("query_id", "version_id", F.lit("folded").alias("origin"), "place", "section_ref", "title", "level")
    return kept.unionByName(folded).where(F.col("place") <= limit)


def version_lists(requests: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """(query_id, document_id, found, place, version_id, published_at, is_current): all versions of each document, latest first.

    A document without versions has one row without a version, an unknown one too, with ``found`` false.
    """
    asked = requests.select("query_id", F.col("document_id").cast("string").alias("document_id"))
    known = documents.select(F.col("document_id").cast("string").alias("k")).distinct()
    rows = versions.select(F.col("document_id").cast("string").alias("v"), "version_id", "published_at", "is_current")
    both = asked.join(known, F.col("document_id") == F.col("k"), "left").join(rows, F.col("k") == F.col("v"), "left")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("published_at"), F.col("version_id"))
    place = F.when(F.col("version_id").isNotNull(), F.row_number().over(order))
    return both.select("query_id", "document_id", F.col("k").isNotNull().alias("found"), place.alias("place"), "version_id", "published_at", "is_current")


def version_differences(requests: DataFrame, documents: DataFrame, versions: DataFrame, fields: tuple[str, ...] = ("published_at", "file_sha256", "is_current")) -> DataFrame:
    """(query_id, error, field, old_value, new_value): what differs between two versions by label; null counts as empty.

    ``requests``: query_id, document_id, version_a, version_b. A label that isn't there is
    an error, an unknown document too; versions without a difference have one row of nulls.
    """
    cells = F.array(*(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))
    rows = versions.select(F.col("document_id").cast("string").alias("v_doc"), F.col("version_label").cast("string").alias("label"), cells.alias("cells")).groupBy("v_doc", "label").agg(F.min("cells").alias("cells"))
    asked = requests.select("query_id", F.col("document_id").cast("string").alias("document_id"), F.col("version_a").cast("string").alias("a"), F.col("version_b").cast("string").alias("b"))
    known = documents.select(F.col("document_id").cast("string").alias("k")).distinct()
    one = lambda x: rows.select(F.col("v_doc").alias(f"{x}_doc"), F.col("label").alias(f"{x}_label"), F.col("cells").alias(f"{x}_cells"))
    got = asked.join(known, F.col("document_id") == F.col("k"), "left")
    for x in "ab":
        got = got.join(one(x), (F.col("k") == F.col(f"{x}_doc")) & (F.col(x) == F.col(f"{x}_label")), "left")
    no_a, no_b = F.col("a_cells").isNull(), F.col("b_cells").isNull()
    error = (
        F.when(F.col("k").isNull(), "document not found")
        .when(no_a & no_b, F.concat(F.lit("Versions '"), "a", F.lit("' and '"), "b", F.lit("' not found")))
        .when(no_a, F.concat(F.lit("Version '"), "a", F.lit("' not found")))
        .when(no_b, F.concat(F.lit("Version '"), "b", F.lit("' not found")))
    )
    parts = F.filter(F.arrays_zip(F.array(*map(F.lit, fields)).alias("field"), F.col("a_cells").alias("old_value"), F.col("b_cells").alias("new_value")), lambda c: c["old_value"] != c["new_value"])
    return got.select("query_id", error.alias("error"), F.explode_outer(F.when(error.isNull(), parts)).alias("c")).select("query_id", "error", "c.*")


def citations(hits: DataFrame, chunks: DataFrame, max_chars: int) -> DataFrame:
    """Hits as citations: query_id, rank and ``CITED``.

    ``chunks``: chunk_id, document_id, text, section_path and, if they have them,
    paragraph_ref, page_start, page_end, chunk_type. An empty reference and page 0 are none.
    """
    kinds = {"paragraph_ref": "string", "page_start": "int", "page_end": "int", "chunk_type": "string"}
    have = [(F.col(c) if c in chunks.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
    rows = hits.select("query_id", "rank", "chunk_id").join(chunks.select("chunk_id", F.col("document_id").cast("string").alias("document_id"), "text", F.coalesce(F.col("section_path").cast("string"), F.lit("")).alias("section_path"), *have), "chunk_id")
    given = {"paragraph_ref": F.nullif("paragraph_ref", F.lit("")), "page_start": F.nullif("page_start", F.lit(0)), "page_end": F.nullif("page_end", F.lit(0))}
    cite = X.citation_string(F.col("document_id"), F.col("paragraph_ref"), F.col("section_path"), F.col("page_start"))
    rows = rows.withColumns(given).withColumn("citation", cite)
    shown = {"truncated": F.length("text") > max_chars, "truncation_offset": X.cut_mark(F.col("text"), max_chars), "text": X.citation_text(F.col("text"), max_chars)}
    return rows.withColumnRenamed("chunk_id", "citation_id").withColumns(shown).select("query_id", "rank", *CITED)


def answers(requests: DataFrame, found: DataFrame, exact: Column, most: int, head_chars: int, limit_chars: int = budget.BUDGET) -> tuple[DataFrame, DataFrame]:
    """(citations that fit, one row a request): capped by number, then by the size of the answer.

    ``requests``: query_id; ``found``: citations with query_id, rank. ``head_chars``: length of
    an answer's JSON without citations. The second: query_id, answerability, available,
    returned, limit_reason. ``exact``: whether a request names a document.
    """
    capped = found.where(F.col("rank") <= most)
    heads = requests.select(F.col("query_id").alias("request_id"), F.lit(head_chars).alias("head_chars"))
    kept = budget.cut_to_budget(capped.withColumnRenamed("query_id", "request_id"), heads, list(CITED), limit_chars).withColumnRenamed("request_id", "query_id")
    kept = materialize(kept, "answers")
    counts = found.groupBy("query_id").agg(F.count("*").alias("available"))
    shown = kept.groupBy("query_id").agg(F.count("*").alias("returned"), F.max("dropped").alias("dropped"))
    rows = requests.withColumn("is_exact", exact).select("query_id", "is_exact").join(counts, "query_id", "left").join(shown, "query_id", "left").fillna(0, ["available", "returned", "dropped"])
    answer = F.when(F.col("available") == 0, "no_match").when(F.col("is_exact") | (F.col("available") == 1), "exact").otherwise("partial")
    reason = F.when(F.col("dropped") > 0, "response_size_chars").when(F.col("returned") < F.col("available"), "citation_cap")
    return kept.drop("dropped"), rows.select("query_id", answer.alias("answerability"), "available", "returned", reason.alias("limit_reason"))


def run_fixtures(fixtures: DataFrame, chunks: DataFrame, is_id: Column, index: DataFrame | None = None, limit: int = 10, tags: list[str] | None = None, max_chars: int = 600) -> DataFrame:
    """(fixture_id, reasons, passed): fixtures as a table of requests, searched, answered and judged.

    ``fixtures``: fixture_id, query, document_id (or null), other filters, tags, tool and what
    ``judge_fixtures`` expects; ``chunks`` as for ``search_chunks`` with section_path. Fixtures of
    tools other than search aren't run: they fail as unanswered.
    """
    asked = evaluate.tagged(fixtures, tags or [])
    requests = asked.where(F.coalesce("tool", F.lit("search")) == "search").withColumnRenamed("fixture_id", "query_id")
    hits = materialize(retrieve.search_chunks(requests, chunks, is_id, limit, index=index), "fixture-hits")
    found = materialize(citations(hits, chunks, max_chars), "fixture-citations")
    named = is_id | (F.coalesce(F.col("document_id").cast("string"), F.lit("")) != "")
    kept, told = answers(requests, found, named, limit, 0)
    cited = kept.withColumnRenamed("query_id", "fixture_id")
    return evaluate.judge_fixtures(asked, told.select(F.col("query_id").alias("fixture_id"), "answerability"), cited, ("citation_id", "document_id", "text", "citation"))
