"""Building a corpus: chunks, manifest, quality metrics, repeated lines, edges, discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import application_date, lines, strip

#: Thresholds of the quality gate (fixed values).
GATE = {"min_chars": 1000, "coverage": 0.85, "refs": 0.70, "broken": 0.05, "empty": 0.10, "duplicates": 0.05, "score": 0.85}


def line_chunks(documents: DataFrame, doc_id: str = "document_id", text: str = "text") -> DataFrame:
    """A chunk for each line that isn't blank; ``sequence_no`` is dense from 1."""
    kept = F.filter(lines(F.col(text)), lambda x: x.rlike(r"\S"))
    each = documents.select(*(c for c in documents.columns if c != text), F.posexplode(kept).alias("pos", "text"))
    hashed = F.substring(F.sha2("text", 256), 1, 8)
    seq = (F.col("pos") + 1).alias("sequence_no")
    return each.select(*(c for c in documents.columns if c != text), seq, "text").withColumn("chunk_id", F.concat_ws(":", F.col(doc_id).cast("string"), hashed, F.lit("p"), F.col("sequence_no").cast("string")))


def manifest(chunks: DataFrame, key: str = "chunk_id", doc: str = "document_id") -> DataFrame:
    """One row: counts, and the hash of the sorted chunk ids.

    The ids are hashed in ranges first, so that no task holds all of them: the
    manifest hash is that of the ranges' hashes in order.
    """
    prefix = F.substring(F.sha2(F.col(key), 256), 1, 2)
    ranges = chunks.groupBy(prefix.alias("range")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "|"), 256).alias("hash"), F.count("*").alias("n"))
    docs = chunks.select(doc).distinct().agg(F.count("*").alias("document_count"))
    whole = ranges.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "hash"))), lambda x: x["hash"]), "|"), 256).alias("manifest_hash"), F.sum("n").alias("chunk_count"))
    return whole.crossJoin(docs)  # one row each


def duplicate_ids(rows: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Number of repeated ids, of surplus rows, and the five least repeated ids."""
    by = by or []
    twice = rows.groupBy(*by, key).agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy(*by).agg(F.count("*").alias("dup_ids"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"), F.slice(F.array_sort(F.collect_set(key)), 1, 5).alias("samples"))


def quality_metrics(pages: DataFrame, chunks: DataFrame, doc: str = "document_id") -> DataFrame:
    """Metrics, checks, score and verdict of each document.

    ``pages``: doc, page_no, text; ``chunks``: doc, chunk_id, text, paragraph_ref.
    """
    bare = strip(F.coalesce("text", F.lit("")))
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    p = pages.groupBy(doc).agg(
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("total_chars"),
        F.count("*").alias("n_pages"),
        F.avg((F.length(bare) > 50).cast("double")).alias("coverage"),
        F.avg((F.length(bare) == 0).cast("double")).alias("empty"),
        F.sum(F.size(words)).alias("words"),
        F.sum(F.size(F.filter(words, lambda w: w.endswith("-")))).alias("broken_words"),
        F.max(F.when(F.col("page_no") == 1, (F.length(bare) > 0).cast("int"))).alias("has_title"),
    )
    c = chunks.groupBy(doc).agg(
        F.count("*").alias("n_chunks"),
        F.avg((F.coalesce("paragraph_ref", F.lit("")) != "").cast("double")).alias("refs"),
        (1 - F.countDistinct("text") / F.count("*")).alias("duplicates"),
        (F.count("*") - F.countDistinct("chunk_id")).alias("dup_ids"),
    )
    both = p.join(c, doc, "left").withColumn("broken", F.when(F.col("words") > 0, F.col("broken_words") / F.col("words")).otherwise(0.0))
    both = both.withColumns({x: F.round(F.coalesce(x, F.lit(0.0)), 4) for x in ("coverage", "empty", "refs", "duplicates", "broken")}).withColumns({x: F.coalesce(x, F.lit(0)) for x in ("n_chunks", "dup_ids", "has_title")})
    checks = [
        F.col("total_chars") >= GATE["min_chars"],
        F.col("n_pages") > 0,
        F.col("coverage") >= GATE["coverage"],
        F.col("refs") >= GATE["refs"],
        F.col("broken") <= GATE["broken"],
        F.col("empty") <= GATE["empty"],
        F.col("duplicates") <= GATE["duplicates"],
        F.col("has_title") == 1,
        F.col("n_chunks") > 0,
    ]
    total = sum((x.cast("int") for x in checks[1:]), checks[0].cast("int"))
    score = F.round(total / len(checks), 4)
    return both.withColumn("score", score).withColumn("passed", (score >= GATE["score"]) & (F.col("dup_ids") == 0))


def repeated_edge_lines(pages: DataFrame, doc: str = "document_id") -> DataFrame:
    """Lines of 1 to 100 characters that are first or last on more than half of a
    document's pages: (doc, line, pages)."""
    kept = F.filter(F.transform(lines(F.col("text")), strip), lambda x: x != "")
    ends = pages.select(doc, "page_no", kept.alias("l")).where(F.size("l") > 0)
    n = pages.groupBy(doc).agg(F.count("*").alias("n"))
    each = ends.select(doc, "page_no", F.explode(F.array_distinct(F.array(F.element_at("l", 1), F.element_at("l", -1)))).alias("line"))
    counts = each.groupBy(doc, "line").agg(F.count("*").alias("pages")).where(F.length("line").between(1, 100))
    return counts.join(n, doc).where(F.col("pages") * 2 > F.col("n")).select(doc, "line", "pages")


def without_lines(pages: DataFrame, repeated: DataFrame, doc: str = "document_id") -> DataFrame:
    """Pages without a document's repeated lines, wherever on the page they stand."""
    drop = repeated.groupBy(doc).agg(F.collect_set("line").alias("drop"))
    none = F.array().cast("array<string>")
    kept = F.filter(lines(F.col("text")), lambda x: ~F.array_contains(F.coalesce("drop", none), strip(x)))
    return pages.join(drop, doc, "left").withColumn("text", F.array_join(kept, "\n")).drop("drop")


def noise_lines(pages: DataFrame, doc: str = "document_id") -> DataFrame:
    """Lines on enough of a document's pages that look like furniture: numbers, ids,
    report marks or capitals."""
    n = pages.groupBy(doc).agg(F.count("*").alias("n"))
    each = pages.select(doc, "page_no", F.explode(F.array_distinct(F.transform(lines(F.col("text")), strip))).alias("line")).where("line <> ''")
    counts = each.groupBy(doc, "line").agg(F.count("*").alias("pages")).join(n, doc)
    letters = F.length(F.regexp_replace("line", r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace("line", r"[^\p{Lu}]", ""))
    looks = F.col("line").rlike(r"^\d+$") | F.col("line").rlike(r"^[A-Z]+/[A-Za-z-]+/\d{4}/\d+$") | F.upper("line").contains("FINAL REPORT") | ((letters > 0) & (capitals >= letters * 0.8))
    return counts.where((F.col("pages") >= F.greatest(F.lit(3), F.floor(F.col("n") * 0.35))) & looks).select(doc, "line", "pages")


def page_split(documents: DataFrame, doc: str = "document_id", text: str = "text") -> DataFrame:
    """Pages at form feeds; blank pages go, page numbers stay."""
    each = documents.select(doc, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\f", -1)).alias("p", "text"))
    return each.where(F.col("text").rlike(r"\S")).select(doc, (F.col("p") + 1).alias("page_no"), "text", F.length("text").alias("char_count"))


def keep_last(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Replace semantics: the last row of each key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("nth = 1").drop("nth")


def suffix_duplicates(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Second and later rows of an id get /DUP and their number."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("nth", nth).withColumn(key, F.when(F.col("nth") > 1, F.concat(F.col(key), F.lit("/DUP"), F.col("nth").cast("string"))).otherwise(F.col(key))).drop("nth")


def resequence(rows: DataFrame, by: str, order: list[Column], name: str = "sequence_no") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def low_confidence_spans(chunks: DataFrame, by: str, seq: str, confidence: str, below: float = 0.8, most: int = 20) -> DataFrame:
    """Runs of neighbouring rows under a threshold, ``most`` rows at most: adds ``span``."""
    w = Window.partitionBy(by).orderBy(seq)
    low = F.coalesce(F.col(confidence), F.lit(0.0)) < below
    rows = chunks.withColumn("low", low).withColumn("start", (F.col("low") & ~F.coalesce(F.lag("low").over(w), F.lit(False))).cast("int"))
    rows = rows.withColumn("island", F.sum("start").over(w)).where("low")
    nth = F.row_number().over(Window.partitionBy(by, "island").orderBy(seq)) - 1
    return rows.withColumn("part", F.floor(nth / most)).withColumn("span", F.concat_ws("-", F.col("island").cast("string"), F.col("part").cast("string"))).drop("low", "start", "island", "part")


#: Titles of current documents, and titles that rule one out (fixed values).
WANTED = r"(?i)\b(guidelines?|recommendations?|opinion|regulatory\s+technical\s+standards?|implementing\s+technical\s+standards?|RTS|ITS)\b"
UNWANTED = (
    r"(?i)\b(consultation|consultative|proposed|proposal|discussion\s+paper|call\s+for\s+advice|response\s+to|feedback|track\s*changes?|tracked\s+changes?|redline|"
    r"mapping\s+report|annex|instructions?|templates?|workbook|presentation|slides?|errata)\b"
)
DRAFT, FINAL_DRAFT = r"(?i)\bdraft\b", r"(?i)\bfinal\b.*?\bdraft\b"
AMENDING, CONSOLIDATED = r"(?i)\b(amending|amended|amends|amendment)\b", r"(?i)\bconsolidated\b"
OTHER_LANGUAGES = "DE|FR|ES|IT|PL|PT|NL|DA|SV|FI|EL|BG|CS|ET|HU|LT|LV|MT|RO|SK|SL"


def current_candidate(title: Column, url: Column) -> Column:
    """Whether a listed file is a current document by its title and URL."""
    said = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.regexp_replace(F.coalesce(url, F.lit("")), r"[_-]|%20", " "))
    draft = said.rlike(DRAFT) & ~said.rlike(FINAL_DRAFT)
    amending = said.rlike(AMENDING) & ~said.rlike(CONSOLIDATED)
    return said.rlike(WANTED) & ~said.rlike(UNWANTED) & ~draft & ~amending


def english_file(url: Column) -> Column:
    """A .pdf whose name has no mark of another language."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(path).endswith(".pdf") & ~name.rlike(rf"(?i)(?:^|[-_\s])({OTHER_LANGUAGES})(?:[-_\s.]|$)")


def page_links(pages: DataFrame, page: str = "page_id", html: str = "html", suffix: str = "") -> DataFrame:
    """(page, pos, href, title) of anchors, in order; ``suffix`` keeps hrefs that end so."""
    pattern = r"(?is)<a\b[^>]*?href=[\"']([^\"']*" + suffix + r"(?:\?[^\"']*)?)[\"'][^>]*>(.*?)</a>"
    pairs = F.arrays_zip(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(pattern), F.lit(2)).alias("title"))
    return pages.select(page, F.posexplode(pairs).alias("pos", "x")).select(page, "pos", "x.href", "x.title")


def first_by_url(links: DataFrame, url: str, order: list[Column], limit: int | None = None) -> DataFrame:
    """The first occurrence of each URL; ``limit`` is the caller's own."""
    out = links.withColumn("nth", F.row_number().over(Window.partitionBy(url).orderBy(*order))).where("nth = 1").drop("nth")
    return out.orderBy(*order).limit(limit) if limit is not None else out


#: A document reference: authority, kind, year, number.
REF = r"(?i)\b([A-Z]{2,6}[-/](?:GL|CP|Op|OP|REP|RTS|ITS|BS|DC|DP|REC|Rec)[-/]\d{4}[-/]\d{1,4})\b"
#: What notes say of another document, by kind of edge (fixed values).
NOTE_VERBS = (("amends", "amend(?:ing|s)"), ("repeals", "repeal(?:ing|s)"), ("replaces", "replac(?:ing|es)"), ("supersedes", "supersed(?:ing|es)"))
#: Kinds that a title implies, the first that fits (fixed values).
TITLE_KINDS = (
    ("consolidates", r"(?i)\bconsolidat(?:es|ing|ed)\b"), ("repeals", r"(?i)\brepeal(?:s|ing|ed)\b"),
    ("supersedes", r"(?i)\b(?:supersed(?:es|ing|ed)|replac(?:es|ing|ed))\b"), ("amends", r"(?i)\bamend(?:s|ing|ed)\b"),
)


def edges_from_notes(notes: DataFrame, doc: str = "document_id", text: str = "notes") -> DataFrame:
    """(source, target, type) that a document's notes state; the last kind of a pair wins."""
    target = r"[A-Z]{2,6}/\w+/\d{4}/\d+"

    def said(i: int, kind: str, verb: str) -> Column:
        found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"(?i)\b{verb}\b.*?({target})"), F.lit(1))
        return F.transform(found, lambda t: F.struct(F.lit(i).alias("i"), F.lit(kind).alias("type"), t.alias("target")))

    found = F.flatten(F.array(*(said(i, k, v) for i, (k, v) in enumerate(NOTE_VERBS))))
    each = notes.select(F.col(doc).alias("source"), F.explode_outer(found).alias("x")).select("source", "x.*").where("target IS NOT NULL AND target <> source")
    return each.groupBy("source", "target").agg(F.max_by("type", "i").alias("type"))


def enrich(pages: DataFrame, documents: DataFrame, doc: str = "document_id", most: int = 10) -> tuple[DataFrame, DataFrame]:
    """What the first ``most`` pages say: (document_id, refs, application_date), and edges (source, target, type, confidence).

    ``pages``: document_id, page_no, text; ``documents``: document_id, title. A document
    without pages says nothing and has no edges. A document's own id is no target, however
    it is written.
    """
    early = pages.where(F.col("page_no") <= most).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    said = documents.select(doc, "title").join(early.select(doc, text.alias("text")), doc, "left")
    told = said.select(doc, "title", references(F.col("text")).alias("refs"), application_date(F.col("text")).alias("application_date"))
    own = F.upper(F.replace(F.col(doc), F.lit("-"), F.lit("/")))
    others = F.filter("refs", lambda r: F.upper(r) != own)
    edges = told.select(F.col(doc).alias("source"), F.explode(others).alias("target"), title_edge_kind(F.coalesce("title", F.lit(""))).alias("type"), F.lit("medium").alias("confidence"))
    return told.drop("title"), edges


def title_edge_kind(title: Column) -> Column:
    """The kind of edge that a title implies; related_to if it says nothing."""
    kind = F.lit("related_to")
    for name, pattern in reversed(TITLE_KINDS):
        kind = F.when(title.rlike(pattern), name).otherwise(kind)
    return kind


def edges_from_text(documents: DataFrame, doc: str = "document_id", title: str = "title", text: str = "text") -> DataFrame:
    """Edges to all other references in a text, typed by the title alone."""
    refs = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(REF), F.lit(1)), lambda r: F.replace(r, F.lit("-"), F.lit("/")))
    each = documents.select(F.col(doc).alias("source"), F.explode_outer(F.array_distinct(refs)).alias("target"), title_edge_kind(F.coalesce(F.col(title), F.lit(""))).alias("type"))
    return each.where("target IS NOT NULL AND target <> source")


def merge_edges(detected: DataFrame, overrides: DataFrame, enriched: DataFrame | None = None) -> DataFrame:
    """Overrides win over detected edges of the same pair and type order; enriched ones are appended as they are."""
    both = detected.withColumn("p", F.lit(1)).unionByName(overrides.withColumn("p", F.lit(0)))
    one = keep_last(both, ["source", "target"], [F.col("p"), F.col("type")]).drop("p")
    return one if enriched is None else one.unionByName(enriched)


def primary_id(refs: Column, title: Column, doc_type: Column) -> Column:
    """Struct (id, confidence): which of a text's references names the document itself."""
    prefix = F.when(doc_type == "guidelines", "GL").when(doc_type == "rts", "RTS").when(doc_type == "its", "ITS")
    fits = F.array_sort(F.filter(refs, lambda r: F.upper(F.get(F.split(r, "/"), F.lit(1))) == prefix))
    n, k = F.size(refs), F.size(fits)
    pick = (
        F.when(n == 0, F.struct(F.lit(None).cast("string").alias("id"), F.lit("unresolved").alias("confidence")))
        .when(n == 1, F.struct(F.element_at(refs, 1).alias("id"), F.lit("high").alias("confidence")))
        .when(k == 1, F.struct(F.element_at(fits, 1).alias("id"), F.lit("high").alias("confidence")))
        .when((k > 1) & F.lower(title).contains("consolidated"), F.struct(F.element_at(fits, 1).alias("id"), F.lit("medium").alias("confidence")))
        .when(k > 1, F.struct(F.element_at(fits, -1).alias("id"), F.lit("medium").alias("confidence")))
        .otherwise(F.struct(F.element_at(refs, 1).alias("id"), F.lit("medium").alias("confidence")))
    )
    return F.when(refs.isNotNull(), pick)


def references(text: Column) -> Column:
    """Distinct references of a text, in order, written with slashes."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(REF), F.lit(1)), lambda r: F.replace(r, F.lit("-"), F.lit("/"))))
