"""Composed read operators: whole tables of requests answered in one plan each.

``search`` takes the path that a request calls for: an id asks for that document's
chunks in their order; other text goes to keyword search, fused with nearest
neighbours where vectors are there and fit; each list is fetched beyond the limit, so
that the order of presentation can choose. ``sections`` reads a stored outline's
ranges, or chunks by the prefix of their reference where the outline has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.core import materialize
from quillspark.functions.text import series_code, tokens
from quillspark.operators import navigate, search
from quillspark.plans import build

#: Ids that were made for documents without one (a fixed pattern).
GENERATED = r"(?i)^[A-Z]+/LARGE-[A-Za-z]+/\d{4}/\d+$"

#: Columns of a citation in compact answers (fixed values).
COMPACT = ("citation_id", "document_id", "paragraph_ref", "page_start", "page_end", "text", "truncated", "truncation_offset", "citation")


def compact(citations: DataFrame, *keep: str) -> DataFrame:
    """Citations without section_path and chunk_type; ``keep``: further columns, as query_id."""
    return citations.select(*keep, *COMPACT)


def with_flags(rows: DataFrame, requested: str = "requested_ref") -> DataFrame:
    """Adds is_anchor (the row is the requested paragraph, not its context) and is_complete
    (its chunk isn't a piece of a longer one). A null reference is no anchor."""
    anchor = F.coalesce(F.col("paragraph_ref") == F.col(requested), F.lit(False))
    return rows.withColumns({"is_anchor": anchor, "is_complete": ~F.contains("chunk_id", F.lit(":sub"))})


def overfetch(limit: int) -> int:
    """Rows that a list gives before presentation."""
    return max(2 * limit, limit + 10)


def vectors_unfit(manifest: dict | None, model: str, dim: int | None) -> str | None:
    """Why a corpus's vectors can't serve queries embedded by ``model``; None if they can."""
    have = manifest or {}
    if not have.get("embedding_model") or not have.get("embedding_dim"):
        return "the corpus states no embedding model or dimension; keyword search only"
    if have["embedding_model"] != model:
        return f"queries are embedded by {model!r}, the corpus by {have['embedding_model']!r}; keyword search only"
    if dim is not None and have["embedding_dim"] != dim:
        return f"{model!r} gives {dim} dimensions, the corpus has {have['embedding_dim']}; keyword search only"
    return None


def split_requests(requests: DataFrame, is_id: Column, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Requests that name a document (query_id, document_id, other filters), and all others (query_id, query, filters).

    ``requests``: query_id, query, document_id (a filter or null) and any of the filters.
    An id as the query names its document, whatever the filter; a filter alone names its
    document, and beside words it only filters. Topics don't filter a named document.
    Aliases (target, source) are followed once.
    """
    said = F.trim(F.coalesce("query", F.lit("")))
    more = [c for c in (*build.FILTERS, "exclude_consultation") if c in requests.columns and c != "document_id"]
    asked = F.when(F.coalesce(F.col("document_id").cast("string"), F.lit("")) != "", F.col("document_id").cast("string"))
    rows = requests.select("query_id", said.alias("query"), asked.alias("document_id"), *more, F.when(is_id, said).alias("said_id"))
    if aliases is not None:
        for c in ("document_id", "said_id"):
            rows = navigate.resolve(rows, aliases, c)
    rows = rows.withColumn("named", F.coalesce("said_id", F.when(F.col("query") == "", F.col("document_id"))))
    ids = rows.where("named IS NOT NULL").select("query_id", F.col("named").alias("document_id"), *(c for c in more if c != "topic"))
    return ids, rows.where("named IS NULL").where("query <> ''").select("query_id", "query", "document_id", *more)


def index_chunks(chunks: DataFrame, columns: tuple[str, ...] = search.INDEXED, name: str = "") -> DataFrame:
    """The keyword index of chunks with the marks of their filters, to be stored."""
    return search.build_index(chunks, list(columns), marks=build.chunk_marks(chunks.columns), name=name)


def asked_terms(words: DataFrame) -> DataFrame:
    """(query_id, term) of requests: their words as tokens, repeats kept, and the marks of their filters."""
    marks = F.array_compact(F.array(F.lit(None).cast("string"), *build.asked_marks(words.columns)))
    return words.select("query_id", F.explode(F.concat(tokens(F.col("query")), marks)).alias("term"))


def search_chunks(
    requests: DataFrame, chunks: DataFrame, is_id: Column, limit: int = 10, aliases: DataFrame | None = None, vectors: DataFrame | None = None, asked_vectors: DataFrame | None = None, columns: tuple[str, ...] = ("text",), index: DataFrame | None = None,
    manifest: dict | None = None, model: str | None = None, dim: int | None = None,
) -> DataFrame:
    """(query_id, chunk_id, mode, rank, warning), at most ``limit`` a request.

    ``requests``: query_id, query, document_id and any of the filters. ``chunks``: chunk_id,
    document_id, sequence_no, document_region, the filters' fields and the indexed
    columns; ``index`` is theirs, by ``index_chunks``, and is built if it isn't given.
    ``vectors`` (chunk_id, embedding) and ``asked_vectors`` (query_id, embedding) switch
    fusion on; a request without a vector has its keyword hits. With ``model``, vectors that
    the manifest says don't fit stay unused, and each row's ``warning`` says so. Where
    chunks have paragraph_ref and text, hits under a generated id go behind a canonical
    hit that says the same, unless the request asks for such an id. ``mode``: exact, and,
    or, hybrid.
    """
    most = overfetch(limit)
    ids, words = split_requests(requests, is_id, aliases)
    extra = [c for c in ("paragraph_ref", "text") if c in chunks.columns]
    rows = chunks.select("chunk_id", F.col("document_id").cast("string").alias("document_id"), "sequence_no", "document_region", *extra)
    named = ids.select("query_id", "document_id", F.array_compact(F.array(F.lit(None).cast("string"), *build.asked_marks([c for c in ids.columns if c != "document_id"]))).alias("asked"))
    marked = chunks.select("chunk_id", F.array_compact(F.array(F.lit(None).cast("string"), *build.chunk_marks(chunks.columns))).alias("marks"))
    of = named.join(rows.select("chunk_id", "document_id", "sequence_no"), "document_id")
    if len(ids.columns) > 2:
        of = of.join(marked, "chunk_id").where(F.size(F.array_except("asked", "marks")) == 0)
    exact = search.ranked(of, [F.col("sequence_no"), F.col("chunk_id")], most).select("query_id", "chunk_id", "rank", F.lit("exact").alias("mode"))

    index = materialize(index_chunks(chunks, columns), "chunk-index") if index is None else index
    found = search.keyword_hits(index, asked_terms(words), most).select("query_id", F.col("key").alias("chunk_id"), "rank", "mode")
    warning = vectors_unfit(manifest, model, dim) if model is not None else None
    if vectors is not None and asked_vectors is not None and warning is None:
        near = search.nearest(asked_vectors.join(words.select("query_id"), "query_id", "left_semi"), vectors, most, key="chunk_id")
        near = _filtered(near, words, marked)
        have = asked_vectors.select("query_id", F.lit(True).alias("has_vector")).distinct()
        fused = search.ranked(search.fuse(found, near).withColumn("score", F.round("score", 9)), search.fused_order(), most)
        said = found.select("query_id", "mode").distinct()
        fused = fused.join(have, "query_id", "left").join(said, "query_id", "left")
        found = fused.select("query_id", "chunk_id", "rank", F.when(F.col("has_vector"), "hybrid").otherwise(F.col("mode")).alias("mode"))
    shown = search.prefer_regions(exact.unionByName(found).join(rows.drop("sequence_no"), "chunk_id"))
    if len(extra) == 2:
        generated = F.col("document_id").rlike(GENERATED)
        asks = requests.select("query_id", F.coalesce(F.trim(F.coalesce("query", F.lit(""))).rlike(GENERATED) | F.coalesce(F.col("document_id").cast("string"), F.lit("")).rlike(GENERATED), F.lit(False)).alias("asks_generated"))
        shown = shown.join(asks, "query_id")
        shown = search.demote_generated(shown, generated & ~F.col("asks_generated") & (F.col("mode") != "exact"), series_code(F.col("document_id")), "paragraph_ref", "text")
    return shown.where(F.col("rank") <= limit).select("query_id", "chunk_id", "mode", "rank", F.lit(warning).alias("warning"))


def _filtered(near: DataFrame, words: DataFrame, marked: DataFrame) -> DataFrame:
    """Nearest chunks that have the marks their request asks for, ranked anew."""
    marks = build.asked_marks(words.columns)
    if not marks:
        return near
    asked = words.select("query_id", F.array_compact(F.array(*marks)).alias("asked"))
    ok = near.join(asked, "query_id").join(marked, "chunk_id").where(F.size(F.array_except("asked", "marks")) == 0)
    return ok.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).drop("asked", "marks")


def with_context(hits: DataFrame, chunks: DataFrame, before: int, after: int, limit: int) -> DataFrame:
    """Hits and their neighbours, anchors first, at most ``limit`` a request: adds ``place`` and is_context.

    ``hits``: query_id, chunk_id, rank; ``chunks``: chunk_id, version_id, sequence_no.
    """
    placed = hits.select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", "version_id", "sequence_no"), "chunk_id")
    both = navigate.context(placed, chunks.select("chunk_id", "version_id", "sequence_no"), before, after)
    order = Window.partitionBy("query_id").orderBy("is_context", "anchor_rank", "sequence_no", "chunk_id")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query_id", "chunk_id", "anchor_rank", "is_context", "place")


def sections(requests: DataFrame, chunks: DataFrame, outline: DataFrame, limit: int = 200) -> DataFrame:
    """(query_id, chunk_id, origin, place): chunks of a section and those below it.

    ``requests``: query_id, version_id, section; ``chunks``: version_id, chunk_id,
    sequence_no, paragraph_ref, section_path, document_region; ``outline``: version_id,
    section_ref, sequence_start, sequence_end. A request that the outline answers is read
    from its ranges (origin stored), all others by prefixes (origin prefix). Where requests
    and chunks have a language, chunks are of the request's language (null: en); stored ranges
    answer only for documents of that language, if chunks say it (document_language).
    """
    by_language = "language" in requests.columns and "language" in chunks.columns
    spoken = [F.coalesce("language", F.lit("en")).alias("q_language")] if by_language else []
    of_chunk = F.col("language") == F.col("q_language") if by_language else F.lit(True)
    of_document = F.col("document_language") == F.col("q_language") if by_language and "document_language" in chunks.columns else F.lit(True)
    asked = requests.select("query_id", *spoken, F.col("version_id").alias("q_version"), F.lower(F.regexp_replace(F.trim("section"), r"\.$", "")).alias("q_section"))
    same = F.col("q_version") == F.col("version_id")

    def below(c: str, mark: str = ".") -> Column:
        text = F.lower(F.coalesce(F.col(c), F.lit("")))
        return F.startswith(text, F.concat("q_section", F.lit(mark)))

    is_ref = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))) == F.col("q_section")
    ranges = asked.join(outline, same & (is_ref("section_ref") | below("section_ref"))).where("sequence_start IS NOT NULL AND sequence_end IS NOT NULL").select("query_id", F.col("version_id").alias("r_version"), "sequence_start", "sequence_end", *(["q_language"] if by_language else []))
    more = [c for c in ("language", "document_language") if by_language and c in chunks.columns]
    columns = chunks.select("version_id", "chunk_id", "sequence_no", "paragraph_ref", "section_path", "document_region", *more)
    stored = ranges.join(columns, (F.col("r_version") == F.col("version_id")) & F.col("sequence_no").between(F.col("sequence_start"), F.col("sequence_end"))).where(of_chunk & of_document).select("query_id", "chunk_id", "sequence_no").distinct()
    stored = materialize(stored.withColumn("origin", F.lit("stored")), "sections-stored")
    other = asked.join(stored.select("query_id"), "query_id", "left_anti")
    fits = is_ref("paragraph_ref") | below("paragraph_ref") | is_ref("section_path") | below("section_path") | below("section_path", ". ")
    prefix = other.join(columns, same & fits).where(of_chunk).select("query_id", "chunk_id", "sequence_no", "document_region")
    first = search.ranked(prefix, [F.col("sequence_no"), F.col("chunk_id")], overfetch(limit))
    shown = search.prefer_regions(first).select("query_id", "chunk_id", F.lit("prefix").alias("origin"), F.col("rank").alias("place"))
    kept = search.ranked(stored, [F.col("sequence_no"), F.col("chunk_id")], limit, name="place").select("query_id", "chunk_id", "origin", "place")
    return kept.unionByName(shown.where(F.col("place") <= limit))
