"""Queries of the corpus engine by name, with their SQL twins.

``documents`` plays the documents, its lines the chunks, ``embeddings`` the vectors,
``benchmark`` the query set, ``pages`` the crawled listings, ``conversations`` the
ordered parts of documents, and the order tables the versioned and linked records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.core import materialize, table
from quillspark.functions import text as X
from quillspark.operators import corpus, crawl, evaluate, filters, navigate, nearest, search, segment
from quillspark.plans import build, reads, retrieve

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("language"), F.col("source").alias("topic"), "text")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return corpus.line_chunks(documents(spark, d))


#: Lines of documents as chunks: document_id, language, topic, sequence_no, text, chunk_id.
CHUNKS = r"""chunks AS (
  SELECT document_id, language, topic, sequence_no, text, document_id::VARCHAR || ':' || substr(sha256(text), 1, 8) || ':p:' || sequence_no AS chunk_id
  FROM (SELECT doc_id AS document_id, lang AS language, source AS topic, l[i] AS text, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS sequence_no
        FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents) x, unnest(range(1, len(l) + 1)) u(i)
        WHERE regexp_matches(l[i], '\S'))
)"""
TOKENS = f"regexp_extract_all(translate(lower({{}}), '{X.ACCENTED}', '{X.PLAIN}'), '[\\p{{{{L}}}}\\p{{{{N}}}}\\p{{{{Co}}}}]+')".replace("{{", "{").replace("}}", "}")


def tok(x: str) -> str:
    return TOKENS.replace("{}", x)


def hits_sql(key: str) -> str:
    """Of q (query_id, term, times, needed), p, s and g: a query's rows with a term, and their scores by all needed terms if any row has these."""
    part = "times * (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
    return f"""h AS (SELECT query_id, {key}, count(*) FILTER (needed) AS matched, sum({part}) AS any_score, sum({part}) FILTER (needed) AS all_score
      FROM q JOIN s USING (term) JOIN p USING (term), g GROUP BY ALL),
r AS (SELECT *, CASE WHEN strict = 1 THEN all_score ELSE any_score END AS score FROM (
        SELECT h.*, n_terms, max((matched = n_terms)::INT) OVER (PARTITION BY query_id) AS strict FROM h JOIN (SELECT query_id, count(*) FILTER (needed) AS n_terms FROM q GROUP BY ALL) USING (query_id) WHERE n_terms > 0))"""


# --- keyword search -------------------------------------------------------------


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """All words of each benchmark item are a query."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(X.tokens(F.col("text"))).alias("term"))


BM25 = f"""t AS (SELECT document_id, {tok("text")} AS w FROM (SELECT doc_id AS document_id, coalesce(text, '') AS text FROM documents)),
p AS (SELECT document_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT document_id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL),
s AS (SELECT term, count(*) AS df FROM p GROUP BY term),
g AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
q AS (SELECT query_id, term, count(*) AS times, term NOT IN ('and', 'or', 'not') AS needed FROM (SELECT item_id AS query_id, unnest({tok("text")}) AS term FROM benchmark) GROUP BY ALL),
{hits_sql("document_id")}"""


def _document_index(spark: SparkSession, d: str) -> DataFrame:
    """The stored index of whole texts."""
    return build.stored(table(spark, d, "documents"), "text-index", lambda: build.by_term(search.build_index(documents(spark, d), ["text"], "document_id")))


def _search(spark: SparkSession, d: str, limit: int = 10) -> DataFrame:
    return search.keyword_hits(_document_index(spark, d), _asked(spark, d), limit).withColumnRenamed("key", "document_id")


@query(
    f"""WITH {BM25}
SELECT query_id, document_id, round(score, 6) AS score, CASE WHEN strict = 1 THEN 'and' ELSE 'or' END AS mode,
  row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, document_id) AS rank
FROM r WHERE (matched = n_terms)::INT = strict QUALIFY rank <= 10"""
)
def bm25_search(spark, d):
    """BM25 with all terms, else any, top ten of each query."""
    return _search(spark, d).select("query_id", "document_id", "score", "mode", F.col("rank").cast("long"))


@query(
    f"""WITH {BM25}, k AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, document_id) AS rank FROM r WHERE (matched = n_terms)::INT = strict QUALIFY rank <= 10)
SELECT query_id, document_id, k.rank, left(replace(text, chr(10), ' '), 200) AS snippet, length(text) > 200 AS truncated,
  document_id::VARCHAR || ', section "' || left(source, 60) || '"' AS citation
FROM k JOIN documents ON doc_id = document_id"""
)
def search_citations(spark, d):
    """Ranked hits as citations."""
    docs = documents(spark, d).withColumnRenamed("document_id", "id")
    got = _search(spark, d).join(docs, F.col("document_id") == F.col("id"))
    cite = X.citation_string(F.col("document_id").cast("string"), F.lit(None).cast("string"), F.col("topic"), F.lit(0))
    return got.select("query_id", "document_id", F.col("rank").cast("long"), X.citation_text(F.col("text"), 200).alias("snippet"), (F.length("text") > 200).alias("truncated"), cite.alias("citation"))


@query(f"WITH t AS (SELECT doc_id, {tok('text')} AS w FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term")
def term_statistics(spark, d):
    """Document and collection frequencies of all terms."""
    return search.index_terms(_document_index(spark, d))


@query(f"WITH t AS (SELECT doc_id, {tok('text')} AS w FROM documents) SELECT count(*) AS n, round(avg(len(w)), 6) AS avgdl FROM t")
def corpus_totals(spark, d):
    """Number and mean length of documents."""
    return search.index_totals(_document_index(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


# --- vectors and fusion ---------------------------------------------------------


def _nearest(spark, d):
    v = table(spark, d, "embeddings")
    return search.nearest(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, 10)


KNN = """n AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10)"""


@query(f"WITH {KNN} SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM n")
def vector_search(spark, d):
    """Exact nearest neighbours of every fiftieth vector."""
    return _nearest(spark, d).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long"))


@query(f"WITH {KNN} SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM n")
def vector_search_clustered(spark, d):
    """The same neighbours out of stored clusters, ruled out by the triangle inequality."""
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got, _ = nearest.nearest_in_clusters(asked, nearest.cluster(v), 10)
    return got.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long"))


#: Hits that each list gives to a fusion of ten.
OVERFETCH = max(2 * 10, 10 + 10)


@query(
    f"""WITH {BM25}, k AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, document_id) AS rank FROM r WHERE (matched = n_terms)::INT = strict QUALIFY rank <= {OVERFETCH}),
n AS (SELECT q.vec_id AS query_id, v.vec_id AS document_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark) QUALIFY rank <= {OVERFETCH}),
f AS (SELECT query_id, document_id, k.rank AS kw, n.rank AS vr, coalesce(1.0 / (60 + k.rank), 0) + coalesce(1.0 / (60 + n.rank), 0) AS score FROM k FULL OUTER JOIN n USING (query_id, document_id))
SELECT query_id, document_id, kw AS kw_rank, vr AS vec_rank, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, kw NULLS LAST, vr NULLS LAST, document_id) AS rank FROM f QUALIFY rank <= 10"""
)
def hybrid_fusion(spark, d):
    """BM25 and nearest neighbours of the query's vector, fused.

    A benchmark item's vector is that of its id; an item without one has its keyword hits alone.
    """
    v = table(spark, d, "embeddings")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).distinct()
    near = search.nearest(v.withColumnRenamed("vec_id", "query_id").join(items, "query_id"), v, OVERFETCH).withColumnRenamed("vec_id", "document_id")
    fused = search.fuse(_search(spark, d, OVERFETCH), near, "document_id").withColumn("score", F.round("score", 9))
    return search.ranked(fused, search.fused_order("document_id"), 10).select("query_id", "document_id", F.col("kw_rank").cast("long"), F.col("vec_rank").cast("long"), "score", F.col("rank").cast("long"))


@query(f"WITH {KNN} SELECT query_id, vec_id, rank FROM n JOIN embeddings USING (vec_id) WHERE label < 5")
def vector_post_filter(spark, d):
    """Hits kept by a filter after the top k."""
    ok = table(spark, d, "embeddings").where("label < 5").select("vec_id")
    return _nearest(spark, d).join(ok, "vec_id", "left_semi").select("query_id", "vec_id", F.col("rank").cast("long"))


@query(f"WITH {KNN}, c AS (SELECT query_id, rank, q.label = v.label AS same FROM n JOIN embeddings v USING (vec_id) JOIN embeddings q ON q.vec_id = query_id WHERE n.vec_id <> query_id), b AS (SELECT query_id, min(rank) FILTER (same) AS rank FROM c GROUP BY ALL) SELECT round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(coalesce((rank <= 5)::INT, 0)), 6) AS recall, count(*) AS queries FROM b")
def retrieval_quality(spark, d):
    """Mean reciprocal rank and recall of neighbours with the query's label."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    hits = materialize(_nearest(spark, d), "nearest")
    # of the hits, those with the query's label: pairs of equal labels aren't made
    relevant = hits.join(v, "vec_id").join(q.withColumnRenamed("label", "asked"), "query_id").where("label = asked AND vec_id <> query_id").select("query_id", "vec_id")
    got = evaluate.retrieval_scores(hits, relevant, q, 5, key="vec_id")
    return got.select(F.round("mrr", 6).alias("mrr"), F.round("recall", 6).alias("recall"), "queries")


@query("""WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (role <> 'user')::INT, rank) AS place FROM r""")
def region_preference(spark, d):
    """Preferred classes first, otherwise in rank order."""
    rows = table(spark, d, "conversations").withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    rows = rows.withColumn("document_region", F.when(F.col("role") == "user", "body").otherwise(F.col("role")))
    return search.prefer_regions(rows, by="conv_id").select("conv_id", "turn", F.col("rank").cast("long").alias("place"))


# --- composed reads ---------------------------------------------------------------

#: Requests: items of the benchmark by their words, and every fiftieth document by its id.
#: The first chunk of a document is front matter.
REQUESTS = f"""{CHUNKS}, t AS (SELECT chunk_id, document_id, sequence_no, CASE WHEN sequence_no = 1 THEN 'front_matter' ELSE 'body' END AS region, {tok("text")} AS w FROM chunks),
p AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL),
s AS (SELECT term, count(*) AS df FROM p GROUP BY term),
g AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
q AS (SELECT query_id, term, count(*) AS times, term NOT IN ('and', 'or', 'not') AS needed FROM (SELECT item_id AS query_id, unnest({tok("text")}) AS term FROM benchmark) GROUP BY ALL),
{hits_sql("chunk_id")},
k AS (SELECT query_id, chunk_id, CASE WHEN strict = 1 THEN 'and' ELSE 'or' END AS mode, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM r WHERE (matched = n_terms)::INT = strict QUALIFY rank <= 20),
e AS (SELECT 1000000 + document_id AS query_id, chunk_id, 'exact' AS mode, row_number() OVER (PARTITION BY document_id ORDER BY sequence_no, chunk_id) AS rank FROM t WHERE document_id % 50 = 0 QUALIFY rank <= 20),
u AS (SELECT query_id, chunk_id, mode, pos AS rank FROM (SELECT query_id, chunk_id, mode, row_number() OVER (PARTITION BY query_id ORDER BY (region = 'front_matter')::INT, x.rank) AS pos FROM (FROM k UNION ALL FROM e) x JOIN t USING (chunk_id)) WHERE pos <= 10)"""


def _read_chunks(spark, d):
    """The stored chunks."""

    def make():
        region = F.when(F.col("sequence_no") == 1, "front_matter").otherwise("body")
        return chunks(spark, d).withColumn("document_region", region).withColumn("version_id", F.col("document_id"))

    return build.stored(table(spark, d, "documents"), "chunks", make)


def _chunk_index(spark, d):
    """The stored index of chunks, from stored chunks."""
    return build.stored(table(spark, d, "documents"), "chunk-index", lambda: build.by_term(retrieve.index_chunks(_read_chunks(spark, d), ("text",))))


def _requests(spark, d):
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    named = table(spark, d, "documents").where("doc_id % 50 = 0").select((F.col("doc_id") + 1000000).alias("query_id"), F.concat(F.lit("id:"), F.col("doc_id").cast("string")).alias("query"))
    return words.unionByName(named).withColumn("document_id", F.lit(None).cast("string"))


def _hits(spark, d):
    ids = F.col("query").rlike("^id:[0-9]+$")
    # an id as requests write it is an alias of the document's own
    own = table(spark, d, "documents").select(F.concat(F.lit("id:"), F.col("doc_id").cast("string")).alias("target"), F.col("doc_id").cast("string").alias("source")).distinct()
    return retrieve.search_chunks(_requests(spark, d), _read_chunks(spark, d), ids, 10, aliases=own, index=_chunk_index(spark, d))


@query(f"WITH {REQUESTS} SELECT query_id, chunk_id, mode, rank FROM u")
def q_search(spark, d):
    """Ids go to their document, other requests to keyword search; over-fetched, then presented."""
    return _hits(spark, d).select("query_id", "chunk_id", "mode", F.col("rank").cast("long"))


@query(
    f"""WITH {REQUESTS}, a AS (SELECT query_id, u.rank, document_id AS d, sequence_no AS n FROM u JOIN t USING (chunk_id)),
x AS (SELECT query_id, chunk_id, sequence_no, rank AS anchor_rank, (sequence_no <> n)::INT AS is_context FROM a JOIN t ON document_id = d AND sequence_no BETWEEN n - 1 AND n + 2
  QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY (sequence_no <> n)::INT, rank, sequence_no) = 1)
SELECT query_id, chunk_id, anchor_rank, is_context::BIGINT AS is_context, row_number() OVER (PARTITION BY query_id ORDER BY is_context, anchor_rank, sequence_no, chunk_id) AS place FROM x QUALIFY place <= 25"""
)
def q_search_context(spark, d):
    """Hits with neighbours, anchors first, capped."""
    got = retrieve.with_context(materialize(_hits(spark, d), "hits"), _read_chunks(spark, d), 1, 2, 25)
    return got.select("query_id", "chunk_id", F.col("anchor_rank").cast("long"), F.col("is_context").cast("long"), F.col("place").cast("long"))


@query(
    f"""WITH {CHUNKS}, c AS (SELECT *, CAST(ceil(sequence_no / 5.0) AS BIGINT) AS s, 1 + (sequence_no - 1) % 5 AS k FROM chunks),
o AS (SELECT document_id AS v, s, min(sequence_no) AS a, max(sequence_no) AS b FROM c WHERE document_id % 2 = 0 GROUP BY ALL),
m AS (SELECT document_id AS query_id, chunk_id, 'stored' AS origin, row_number() OVER (PARTITION BY document_id ORDER BY sequence_no) AS place FROM c JOIN o ON v = document_id AND o.s = 2 AND sequence_no BETWEEN a AND b),
f AS (SELECT document_id AS query_id, chunk_id, 'prefix' AS origin, row_number() OVER (PARTITION BY document_id ORDER BY (sequence_no = 1)::INT, sequence_no) AS place FROM c WHERE document_id % 2 = 1 AND s = 2)
SELECT * FROM m WHERE place <= 4 UNION ALL SELECT * FROM f WHERE place <= 4"""
)
def q_section(spark, d):
    """Q4: section 2 of every document, from stored outlines of even ids, else by prefix."""
    c = _read_chunks(spark, d).withColumn("section", F.ceil(F.col("sequence_no") / 5).cast("string"))
    c = c.withColumn("paragraph_ref", F.concat_ws(".", "section", (1 + (F.col("sequence_no") - 1) % 5).cast("string"))).withColumn("section_path", F.lit(None).cast("string"))
    stored = c.where("version_id % 2 = 0").groupBy("version_id", F.col("section").alias("section_ref")).agg(F.min("sequence_no").alias("sequence_start"), F.max("sequence_no").alias("sequence_end"))
    asked = documents(spark, d).select(F.col("document_id").alias("query_id"), F.col("document_id").alias("version_id"), F.lit("2.").alias("section")).distinct()
    return retrieve.sections(asked, c, stored, 4).select("query_id", "chunk_id", "origin", F.col("place").cast("long"))


# --- filters and lists ----------------------------------------------------------


@query("SELECT doc_id AS document_id, lang AS language, source AS topic FROM documents WHERE lang = 'en' AND source = 'src3'")
def equality_filters(spark, d):
    """conjunction of the filters that are given."""
    given = {"language": "en", "topic": "src3", "document_id": None}
    return documents(spark, d).where(filters.equalities(given, ("language", "topic", "document_id"))).select("document_id", "language", "topic")


@query("SELECT doc_id AS document_id FROM documents WHERE upper(source) = 'SRC1' OR contains(lower(text), 'eaux') OR contains(lower(text), 'thin')")
def topic_expansion(spark, d):
    """a topic that stands for terms as well."""
    return documents(spark, d).where(filters.topic("src1", title_col="text", terms={"SRC1": ("eaux", "thin")})).select("document_id")


@query(f"WITH {CHUNKS} SELECT language, count(*) AS n FROM chunks WHERE NOT (lower(text) LIKE '%the%and%' OR lower(text) LIKE 'as.' OR lower(text) LIKE '%eaux%') GROUP BY language")
def consultation_exclusion(spark, d):
    """chunks whose path matches none of the patterns."""
    return chunks(spark, d).where(filters.not_consultation("text", ("%the%and%", "as.", "%eaux%"))).groupBy("language").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS document_id, lang AS language, source AS topic FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 20")
def list_documents(spark, d):
    """A filtered list in id order."""
    return documents(spark, d).where(filters.equalities({"language": "fr"})).select("document_id", "language", "topic").orderBy("document_id").limit(20)


@query("SELECT doc_id AS document_id, coalesce(quality = 1, true) AS passed FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality = 1, true)")
def quality_gate(spark, d):
    """a document without a report passes."""
    got = documents(spark, d).join(table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), (F.col("quality") == 1).alias("passed")), "document_id", "left")
    return got.where(filters.passed_gate()).select("document_id", F.coalesce("passed", F.lit(True)).alias("passed"))


@query("SELECT lang AS language, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, 1")
def type_counts(spark, d):
    """A14."""
    return documents(spark, d).groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


# --- positions, sections, outlines ----------------------------------------------


@query(f"WITH {CHUNKS} SELECT chunk_id, c.document_id, sequence_no, length(c.text) AS n, n_chars FROM chunks c JOIN documents ON doc_id = document_id")
def chunk_hydration(spark, d):
    """J1, W5, G1 ids: chunks with their documents' columns."""
    meta = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "n_chars")
    return chunks(spark, d).join(meta, "document_id").select("chunk_id", "document_id", F.col("sequence_no").cast("long"), F.length("text").cast("long").alias("n"), "n_chars")


CONTEXT = """a AS (SELECT conv_id AS query_id, turn AS h, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations QUALIFY rank <= 2),
x AS (SELECT query_id, c.turn, rank, (c.turn <> h)::INT AS is_context FROM a JOIN conversations c ON c.conv_id = query_id AND c.turn BETWEEN h - 1 AND h + 1)"""


@query(f"WITH {CONTEXT} SELECT query_id, turn, is_context::BIGINT AS is_context, rank AS anchor_rank FROM x QUALIFY row_number() OVER (PARTITION BY query_id, turn ORDER BY is_context, rank) = 1")
def context_window(spark, d):
    """Neighbours by sequence value, each once, anchors first."""
    rows = table(spark, d, "conversations")
    order = Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn")
    hits = rows.withColumn("rank", F.row_number().over(order)).where("rank <= 2").select(F.col("conv_id").alias("query_id"), "conv_id", "turn", "rank")
    got = navigate.context(hits, rows.select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("chunk_id")), 1, 1, "conv_id", "turn")
    return got.select("query_id", "turn", F.col("is_context").cast("long"), F.col("anchor_rank").cast("long"))


SECTIONS = "s AS (SELECT document_id, CAST(ceil(sequence_no / 5.0) AS BIGINT) AS section, min(sequence_no) AS a, max(sequence_no) AS b FROM chunks GROUP BY ALL)"


def _sectioned(spark, d):
    """Five lines a section, references 1, 1.1, ... by their length."""
    c = chunks(spark, d).withColumnRenamed("document_id", "version_id")
    return c.withColumn("section_ref", F.ceil(F.col("sequence_no") / 5).cast("string"))


@query(f"WITH {CHUNKS}, {SECTIONS} SELECT s.document_id, section, count(*) AS n, min(chunk_id) AS first_chunk FROM s JOIN chunks c ON c.document_id = s.document_id AND c.sequence_no BETWEEN a AND b GROUP BY ALL")
def section_ranges(spark, d):
    """Chunks within sections' ranges."""
    c = _sectioned(spark, d)
    s = c.groupBy("version_id", "section_ref").agg(F.min("sequence_no").alias("sequence_start"), F.max("sequence_no").alias("sequence_end"))
    got = navigate.section_chunks(s, c.select("version_id", "sequence_no", "chunk_id"))
    return got.groupBy(F.col("version_id").alias("document_id"), F.col("section_ref").cast("long").alias("section")).agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_chunk"))


@query("""SELECT conv_id, role AS section_ref, arg_min(left(text, 20), turn) AS title, min(turn) AS sequence_start, max(turn) AS sequence_end, min(length(text))::BIGINT AS page_start, max(length(text))::BIGINT AS page_end
FROM conversations WHERE role <> 'system' GROUP BY ALL""")
def outline_rows(spark, d):
    """Sections with first titles and ranges."""
    c = table(spark, d, "conversations")
    rows = c.select(
        F.col("conv_id").alias("version_id"), F.col("turn").alias("sequence_no"), F.col("role").alias("section_ref"), F.substring("text", 1, 20).alias("section_title"), F.lit(1).alias("section_level"), F.lit(None).cast("string").alias("parent_section_ref"),
        F.lit(1.0).alias("metadata_confidence"), F.length("text").alias("page_start"), F.length("text").alias("page_end"), F.when(F.col("role") == "system", "front_matter").alias("document_region"),
    )
    got = navigate.outline(rows)
    return got.select(F.col("version_id").alias("conv_id"), "section_ref", "title", "sequence_start", "sequence_end", F.col("page_start").cast("long"), F.col("page_end").cast("long"))


@query("""SELECT conv_id, to_json(list(role ORDER BY f)) AS refs, min(a) AS first_seq, max(b) AS last_seq, sum(n)::BIGINT AS chunk_count
FROM (SELECT conv_id, role, min(turn) AS f, min(turn) AS a, max(turn) AS b, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id""")
def outline_summary(spark, d):
    """Distinct references in order, ranges and counts."""
    got = navigate.chunk_summary(table(spark, d, "conversations"), ["conv_id"], "role", "turn")
    return got.select("conv_id", F.to_json("paragraph_refs").alias("refs"), "first_seq", "last_seq", "chunk_count")


@query(f"WITH {CHUNKS} SELECT chunk_id, sequence_no, text FROM chunks WHERE sequence_no IN (1, 3)")
def paragraph_lookup(spark, d):
    """Paragraphs by a list of references, in all documents."""
    refs = spark.createDataFrame([(1,), (3,)], "ref int")
    got = chunks(spark, d).join(F.broadcast(refs), F.col("sequence_no") == F.col("ref"))  # two rows
    return got.select("chunk_id", F.col("sequence_no").cast("long"), "text")


@query(f"WITH {CHUNKS}, m AS (SELECT document_id, arg_max(text, length(text) * 100000 - sequence_no) AS longest, count(*) AS n FROM chunks GROUP BY ALL) SELECT document_id, left(longest, 30) AS longest, n FROM m")
def document_head(spark, d):
    """Q2: documents with a view of their chunks."""
    got = chunks(spark, d).groupBy("document_id").agg(F.max_by("text", F.length("text").cast("long") * F.lit(100000) - F.col("sequence_no")).alias("longest"), F.count("*").alias("n"))
    return got.select("document_id", F.substring("longest", 1, 30).alias("longest"), "n")


# --- edges, versions, life cycle --------------------------------------------------


def _edges(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "consolidates").when(F.col("l_returnflag") == "R", "replaces").otherwise(F.when(F.col("l_linestatus") == "O", "supersedes").otherwise("amends"))
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), kind.alias("type"))


EDGES = "e AS (SELECT l_partkey AS source, l_suppkey AS target, CASE WHEN l_returnflag = 'A' THEN 'consolidates' WHEN l_returnflag = 'R' THEN 'replaces' WHEN l_linestatus = 'O' THEN 'supersedes' ELSE 'amends' END AS type FROM lineitem)"


@query(
    f"""WITH {EDGES} SELECT target, source FROM e JOIN part ON p_partkey = source WHERE type <> 'amends' AND source <> target
QUALIFY row_number() OVER (PARTITION BY target ORDER BY CASE type WHEN 'consolidates' THEN 0 WHEN 'replaces' THEN 1 ELSE 2 END, p_type DESC, source DESC) = 1"""
)
def alias_resolution(spark, d):
    """The best stand-in of each target, one hop away."""
    known = table(spark, d, "part").select(F.col("p_partkey").alias("document_id"), F.col("p_type").alias("published_at"))
    return navigate.best_alias(_edges(spark, d).distinct(), known)


@query(
    f"""WITH {EDGES}, b AS (SELECT target, list(DISTINCT source ORDER BY source) FILTER (type = 'amends') AS am, list(DISTINCT source ORDER BY source) FILTER (type IN ('supersedes', 'replaces')) AS su FROM e GROUP BY ALL)
SELECT s_suppkey AS document_id, coalesce(len(am), 0)::BIGINT AS n_amended, coalesce(len(su), 0)::BIGINT AS n_superseded, coalesce(len(am), 0) > 0 AND coalesce(len(su), 0) = 0 AS is_partially_superseded, contains(lower(s_name), '1') AS is_consultation
FROM supplier LEFT JOIN b ON target = s_suppkey"""
)
def status_flags(spark, d):
    """Reverse edges and the flags that follow."""
    docs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("document_id"), F.regexp_replace("s_name", "1", "consultation").alias("publication_status"))
    got = navigate.lifecycle(docs, _edges(spark, d))
    return got.select("document_id", F.size("amended_by").cast("long").alias("n_amended"), F.size("superseded_by").cast("long").alias("n_superseded"), "is_partially_superseded", "is_consultation")


def _versions(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("published_at"), F.col("o_orderpriority").alias("file_sha256"), (F.col("o_orderstatus") == "F").alias("is_current"))


@query("SELECT o_custkey AS document_id, o_orderkey AS version_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderdate DESC, o_orderkey DESC) = 1")
def latest_versions(spark, d):
    """The current version of each document."""
    return navigate.latest_version(_versions(spark, d)).select("document_id", "version_id")


@query(
    """WITH v AS (SELECT o_custkey AS k, max(o_orderkey) AS b, min(o_orderkey) AS a FROM orders GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT k, x.o_orderpriority AS op, y.o_orderpriority AS np, CASE WHEN x.o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS oc, CASE WHEN y.o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS nc FROM v JOIN orders x ON x.o_orderkey = a JOIN orders y ON y.o_orderkey = b)
SELECT k AS document_id, 'file_sha256' AS field, op AS old, np AS new FROM p WHERE op <> np UNION ALL SELECT k, 'is_current', oc, nc FROM p WHERE oc <> nc"""
)
def version_diff(spark, d):
    """Q10: fields that differ between two versions."""
    v = _versions(spark, d)
    pairs = v.groupBy("document_id").agg(F.min("version_id").alias("from_version"), F.max("version_id").alias("to_version")).where("from_version < to_version")
    return navigate.diff_versions(pairs, v, ("file_sha256", "is_current"))


@query(
    """WITH c AS (SELECT l_orderkey + l_linenumber % 2 * 100000000 AS chunk_id FROM lineitem)
SELECT chunk_id, o_custkey AS document_id, o_custkey IS NOT NULL AS "exists", o_custkey IS NOT NULL AND NOT coalesce(c_acctbal < 0, false) AS current FROM c LEFT JOIN orders ON o_orderkey = chunk_id LEFT JOIN customer ON c_custkey = o_custkey"""
)
def citation_validation(spark, d):
    """Q11: what cited ids name, aliases aside."""
    cited = table(spark, d, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber") % 2 * F.lit(100000000)).alias("chunk_id"))
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"))
    status = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), (F.col("c_acctbal") < 0).alias("superseded"))
    return navigate.validate_citations(cited, known, status).select("chunk_id", "document_id", "exists", "current")


# --- corpus quality -----------------------------------------------------------------


@query(
    r"""WITH pg AS (SELECT conv_id AS d, turn, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS b, role, md5(text) AS m FROM conversations),
a AS (SELECT d, sum(length(t))::BIGINT AS total_chars, count(*) AS n_pages, round(avg((length(b) > 50)::INT), 4) AS coverage, round(avg((length(b) = 0)::INT), 4) AS empty,
  round(avg((role = 'user')::INT), 4) AS refs, round(1 - count(DISTINCT t) / count(*), 4) AS duplicates, max(CASE WHEN turn = 1 THEN (length(b) > 0)::INT END) AS has_title,
  sum(CASE WHEN b = '' THEN 0 ELSE len(regexp_split_to_array(b, '\s+')) END) AS words, sum(len(list_filter(regexp_split_to_array(b, '\s+'), lambda x: x LIKE '%-'))) AS broken_words FROM pg GROUP BY d),
s AS (SELECT *, round(CASE WHEN words > 0 THEN broken_words / words ELSE 0 END, 4) AS broken FROM a)
SELECT d AS document_id, total_chars, n_pages, coverage, empty, refs, duplicates, broken,
  round(((total_chars >= 1000)::INT + 1 + (coverage >= 0.85)::INT + (refs >= 0.7)::INT + (broken <= 0.05)::INT + (empty <= 0.1)::INT + (duplicates <= 0.05)::INT + coalesce(has_title, 0) + 1) / 9, 4) AS score,
  round(((total_chars >= 1000)::INT + 1 + (coverage >= 0.85)::INT + (refs >= 0.7)::INT + (broken <= 0.05)::INT + (empty <= 0.1)::INT + (duplicates <= 0.05)::INT + coalesce(has_title, 0) + 1) / 9, 4) >= 0.85 AS passed
FROM s"""
)
def quality_report(spark, d):
    """A6, A8, SNK7: metrics, score and verdict of each document."""
    c = table(spark, d, "conversations")
    pages = c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_no"), "text")
    ch = c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_id"), "text", F.when(F.col("role") == "user", "1").alias("paragraph_ref"))
    return corpus.quality_metrics(pages, ch).select("document_id", "total_chars", "n_pages", "coverage", "empty", "refs", "duplicates", "broken", "score", "passed")


@query(f"WITH {CHUNKS}, t AS (SELECT language, text, count(*) AS n FROM chunks GROUP BY ALL HAVING count(*) > 1) SELECT language, count(*) AS dup_ids, sum(n - 1)::BIGINT AS surplus, to_json(list_sort(list(text))[1:5]) AS samples FROM t GROUP BY language")
def duplicate_summary(spark, d):
    """Repeated keys, surplus rows and the least five samples."""
    return corpus.duplicate_ids(chunks(spark, d), "text", ["language"]).select("language", "dup_ids", "surplus", F.to_json("samples").alias("samples"))


@query(
    f"""WITH {CHUNKS}, r AS (SELECT substr(sha256(chunk_id), 1, 2) AS g, sha256(string_agg(chunk_id, '|' ORDER BY chunk_id)) AS h, count(*) AS n FROM chunks GROUP BY 1)
SELECT sha256(string_agg(h, '|' ORDER BY g)) AS manifest_hash, sum(n)::BIGINT AS chunk_count, (SELECT count(DISTINCT document_id) FROM chunks) AS document_count FROM r"""
)
def corpus_manifest(spark, d):
    """A5, A1, Q7, SNK4: counts and the hash of all chunk ids."""
    return corpus.manifest(chunks(spark, d))


#: Turns as pages, each with a running header, a page number and a footer that some pages lack.
PAGED = """pg AS (SELECT conv_id AS document_id, turn AS page_no, 'FINAL REPORT ' || conv_id || chr(10) || coalesce(text, '') || chr(10) || CASE WHEN turn % 3 = 0 THEN 'Page' ELSE 'DRAFT ' || turn % 2 END AS text FROM conversations)"""


def _paged(spark, d):
    foot = F.when(F.col("turn") % 3 == 0, "Page").otherwise(F.concat(F.lit("DRAFT "), (F.col("turn") % 2).cast("string")))
    text = F.concat(F.lit("FINAL REPORT "), F.col("conv_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"), foot)
    return table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_no"), text.alias("text"))


@query(
    rf"""WITH {PAGED}, l AS (SELECT document_id, page_no, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM pg),
e AS (SELECT DISTINCT document_id, page_no, unnest([l[1], l[-1]]) AS line FROM l WHERE len(l) > 0), n AS (SELECT document_id, count(*) AS n FROM pg GROUP BY 1)
SELECT document_id, line, count(*) AS pages FROM e JOIN n USING (document_id) WHERE length(line) BETWEEN 1 AND 100 GROUP BY document_id, line, n HAVING count(*) * 2 > n"""
)
def repeated_headers(spark, d):
    """First and last lines on more than half of the pages."""
    return corpus.repeated_edge_lines(_paged(spark, d))


@query(
    rf"""WITH {PAGED}, l AS (SELECT DISTINCT document_id, page_no, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM pg), n AS (SELECT document_id, count(*) AS n FROM pg GROUP BY 1),
c AS (SELECT document_id, line, count(*) AS pages, any_value(n) AS n FROM l JOIN n USING (document_id) WHERE line <> '' GROUP BY document_id, line)
SELECT document_id, line, pages FROM c WHERE pages >= greatest(3, floor(n * 0.35)) AND (regexp_matches(line, '^\d+$') OR contains(upper(line), 'FINAL REPORT')
  OR (length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) > 0 AND length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) >= length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) * 0.8))"""
)
def page_noise(spark, d):
    """A10: repeated furniture lines."""
    return corpus.noise_lines(_paged(spark, d))


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice / 400009.0 AS c FROM orders),
a AS (SELECT *, c < 0.5 AS low, lag(c < 0.5) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS was FROM r),
b AS (SELECT *, sum((low AND NOT coalesce(was, false))::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island FROM a),
k AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey, island ORDER BY o_orderkey) - 1) // 3 AS part FROM b WHERE low)
SELECT o_custkey AS document_id, island::VARCHAR || '-' || part::VARCHAR AS span, round(min(c), 6) AS lo, round(avg(c), 6) AS mean, round(max(c), 6) AS hi, count(*) AS n FROM k GROUP BY ALL"""
)
def low_confidence(spark, d):
    """Runs of rows under a threshold, three at most, and their confidence."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), "o_orderkey", (F.col("o_totalprice") / 400009.0).alias("c"))
    got = corpus.low_confidence_spans(rows, "document_id", "o_orderkey", "c", 0.5, 3)
    return evaluate.span_confidence(got, ["document_id", "span"], "c").withColumns({c: F.round(c, 6) for c in ("lo", "mean", "hi")})


@query("SELECT o_orderkey, CASE WHEN n > 1 THEN k || '/DUP' || n ELSE k END AS ident FROM (SELECT o_orderkey, o_custkey::VARCHAR AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)")
def duplicate_suffix(spark, d):
    """W7, SNK6: later rows of an id get a suffix."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("ident"))
    return corpus.suffix_duplicates(rows, "ident", [F.col("o_orderkey")])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def replace_rows(spark, d):
    """SNK1, J7: the last row of each key stands."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return corpus.keep_last(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


# --- discovery ------------------------------------------------------------------------

LINKS = r"""a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?href=["'']([^"'']*(?:\?[^"'']*)?)["''][^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\b[^>]*?href=["'']([^"'']*(?:\?[^"'']*)?)["''][^>]*>(.*?)</a>', 2) AS t FROM pages),
k AS (SELECT page_id, i - 1 AS pos, h[i] AS href, t[i] AS title FROM a, unnest(range(1, len(h) + 1)) u(i))"""


@query(f"WITH {LINKS} SELECT page_id, pos, href, title FROM k")
def link_scan(spark, d):
    """SRC1, SRC3: anchors of stored pages in order."""
    return corpus.page_links(table(spark, d, "pages")).select("page_id", F.col("pos").cast("long"), "href", "title")


@query(f"WITH {LINKS} SELECT href, page_id, pos FROM k QUALIFY row_number() OVER (PARTITION BY href ORDER BY page_id, pos) = 1")
def first_links(spark, d):
    """SRC1, U3: the first occurrence of each link."""
    got = corpus.first_by_url(corpus.page_links(table(spark, d, "pages")), "href", [F.col("page_id"), F.col("pos")])
    return got.select("href", "page_id", F.col("pos").cast("long"))


@query(
    f"""WITH {CHUNKS}, r AS (SELECT document_id, chunk_id, sequence_no, row_number() OVER (PARTITION BY document_id ORDER BY sequence_no, chunk_id) AS rank FROM chunks QUALIFY rank <= 110)
SELECT document_id AS query_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY (sequence_no = 1)::INT, rank) AS place FROM r QUALIFY place <= 5"""
)
def q_document(spark, d):
    """Q2: the chunks that each document's read begins with."""
    asked = documents(spark, d).select(F.col("document_id").alias("query_id"), "document_id")
    return reads.document_heads(asked, _read_chunks(spark, d)).select("query_id", "chunk_id", F.col("place").cast("long"))


def _with_refs(spark, d):
    return _read_chunks(spark, d).withColumn("paragraph_ref", F.concat(F.lit("p"), (1 + (F.col("sequence_no") - 1) % 5).cast("string")))


@query(
    f"""WITH {CHUNKS}, c AS (SELECT *, 'p' || (1 + (sequence_no - 1) % 5) AS ref FROM chunks),
m AS (SELECT document_id AS query_id, document_id AS d, sequence_no AS s, CASE WHEN ref = 'p4' THEN 0 ELSE 1 END AS k FROM c WHERE ref IN ('p4', 'p2') AND language IN ('en', 'fr')),
x AS (SELECT query_id, chunk_id, k, s, sequence_no, ref FROM m JOIN c ON document_id = d AND sequence_no BETWEEN s - 1 AND s + 1 QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY k, s, sequence_no) = 1)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY k, s, sequence_no) AS place, ref IN ('p4', 'p2') AS is_anchor, true AS is_complete FROM x"""
)
def q_paragraph(spark, d):
    """Two references of every document, with neighbours; each chunk once."""
    docs = documents(spark, d).where("language IN ('en', 'fr')")
    asked = docs.select(F.col("document_id").alias("query_id"), "document_id", "language", F.posexplode(F.array(F.lit("p4"), F.lit("p2"))).alias("ref_no", "paragraph_ref"))
    return reads.paragraphs(asked, _with_refs(spark, d), 1, 1).select("query_id", "chunk_id", F.col("place").cast("long"), "is_anchor", "is_complete")


@query(
    """SELECT c_custkey AS query_id, c_custkey::VARCHAR AS document_id, c_custkey % 3 > 0 AS found,
  CASE WHEN o_orderkey IS NOT NULL THEN row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) END AS place, o_orderkey AS version_id
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND c_custkey % 3 > 0"""
)
def q_versions(spark, d):
    """Q9: all versions of each document, latest first; documents that aren't known keep a row."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_custkey").alias("document_id"))
    got = reads.version_lists(c, c.where("document_id % 3 > 0"), _versions(spark, d))
    return got.select("query_id", "document_id", "found", F.col("place").cast("long"), "version_id")


@query(
    """WITH v AS (SELECT o_custkey AS k, max(o_orderkey) AS b, min(o_orderkey) AS a FROM orders GROUP BY 1),
q AS (SELECT k, CASE WHEN k % 5 = 0 THEN -1 ELSE a END AS a, CASE WHEN k % 7 = 0 THEN -2 ELSE b END AS b FROM v),
p AS (SELECT k, q.a, q.b, x.o_orderkey AS xa, y.o_orderkey AS yb, x.o_orderpriority AS op, y.o_orderpriority AS np, CASE WHEN x.o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS oc, CASE WHEN y.o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS nc
      FROM q LEFT JOIN orders x ON x.o_orderkey = q.a LEFT JOIN orders y ON y.o_orderkey = q.b),
e AS (SELECT *, CASE WHEN xa IS NULL AND yb IS NULL THEN format('Versions {1}{0}{1} and {1}{2}{1} not found', a, chr(39), b) WHEN xa IS NULL THEN format('Version {1}{0}{1} not found', a, chr(39)) WHEN yb IS NULL THEN format('Version {1}{0}{1} not found', b, chr(39)) END AS error FROM p),
f AS (SELECT k, 'file_sha256' AS field, op AS old_value, np AS new_value FROM e WHERE error IS NULL AND op <> np UNION ALL SELECT k, 'is_current', oc, nc FROM e WHERE error IS NULL AND oc <> nc)
SELECT k AS query_id, error, field, old_value, new_value FROM e LEFT JOIN f USING (k)"""
)
def q_difference(spark, d):
    """Q10: two versions of each document by label, labels that aren't there among them."""
    v = _versions(spark, d).withColumn("version_label", F.col("version_id"))
    two = v.groupBy("document_id").agg(F.min("version_id").alias("version_a"), F.max("version_id").alias("version_b"))
    asked = two.select(F.col("document_id").alias("query_id"), "document_id", F.when(F.col("document_id") % 5 == 0, -1).otherwise(F.col("version_a")).alias("version_a"), F.when(F.col("document_id") % 7 == 0, -2).otherwise(F.col("version_b")).alias("version_b"))
    return reads.version_differences(asked, two, v, ("file_sha256", "is_current"))


#: An answer's JSON without citations, and the budget of the queries below.
HEAD_CHARS, ANSWER_CHARS = 200, 2500
CITATIONS = f"""{REQUESTS}, i AS (SELECT u.*, c.chunk_id AS citation_id, c.document_id::VARCHAR AS document_id, coalesce(topic, '') AS section_path, left(replace(text, chr(10), ' '), 300) AS cut, length(text) > 300 AS truncated,
  CASE WHEN length(text) > 300 THEN '300 / ' || length(text) END AS truncation_offset, c.document_id::VARCHAR || ', section "' || left(coalesce(topic, ''), 60) || '"' AS citation FROM u JOIN chunks c USING (chunk_id) WHERE u.rank <= 8),
z AS (SELECT *, list_sum(list_transform([citation_id, document_id, section_path, cut, citation], lambda x: length(to_json(x)))) + coalesce(length(truncation_offset) + 2, 4) + CASE WHEN truncated THEN 4 ELSE 5 END + 4 * 4
  + list_sum(list_transform(['{"', '".join(reads.CITED)}'], lambda k: length(k) + 3)) + 2 + {len(reads.CITED) - 1} + 8 * {len(reads.CITED)} + 9 AS chars FROM i),
y AS (SELECT *, {HEAD_CHARS} + 4 + sum(chars) OVER w + 2 * (row_number() OVER w - 1) AS total, row_number() OVER w AS nth, count(*) OVER (PARTITION BY query_id) AS many FROM z WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
s8 AS (SELECT * FROM y WHERE total <= {ANSWER_CHARS} OR nth = 1)"""


def _answers(spark, d):
    found = materialize(_hits(spark, d), "search-hits")
    cited = reads.citations(found, _read_chunks(spark, d).withColumn("section_path", F.col("topic")), 300)
    return reads.answers(_requests(spark, d), materialize(cited, "citations"), F.col("query").rlike("^id:[0-9]+$"), 8, HEAD_CHARS, ANSWER_CHARS)


@query(
    f"""WITH {CITATIONS}, c8 AS (SELECT query_id, count(*) AS available FROM u GROUP BY ALL), k8 AS (SELECT query_id, count(*) AS returned, max(many) - count(*) AS dropped FROM s8 GROUP BY ALL),
a8 AS (SELECT item_id AS query_id, false AS is_exact FROM benchmark UNION ALL SELECT 1000000 + doc_id, true FROM documents WHERE doc_id % 50 = 0)
SELECT query_id, CASE WHEN coalesce(available, 0) = 0 THEN 'no_match' WHEN is_exact OR available = 1 THEN 'exact' ELSE 'partial' END AS answerability, coalesce(available, 0) AS available, coalesce(returned, 0) AS returned,
  CASE WHEN dropped > 0 THEN 'response_size_chars' WHEN coalesce(returned, 0) < available THEN 'citation_cap' END AS limit_reason FROM a8 LEFT JOIN c8 USING (query_id) LEFT JOIN k8 USING (query_id)"""
)
def q_answers(spark, d):
    """What each search answers, capped by number and by the size of its JSON."""
    return _answers(spark, d)[1]


@query(
    f"""WITH {CITATIONS} SELECT query_id, rank, citation_id, document_id, section_path, CASE WHEN nth = 1 AND total > {ANSWER_CHARS} THEN left(cut, 200) ELSE cut END AS text, truncated OR (nth = 1 AND total > {ANSWER_CHARS}) AS truncated, truncation_offset, citation,
  NULL::VARCHAR AS paragraph_ref, NULL::INT AS page_start, NULL::INT AS page_end, NULL::VARCHAR AS chunk_type FROM s8"""
)
def q_citations(spark, d):
    """Searches answered by citations that fit their budget."""
    return _answers(spark, d)[0].withColumn("rank", F.col("rank").cast("long"))


#: Listings of the crawl: pages dealt to so many kinds, read in the order of their ids.
KINDS = 6


@query(
    f"""WITH RECURSIVE {LINKS},
l AS (SELECT page_id % {KINDS} AS kind, page_id // {KINDS} AS page_no, pos, regexp_replace(href, '[?#].*$', '') AS url, title FROM k),
c AS (SELECT kind, page_no, pos, url, title FROM l WHERE regexp_full_match(url, '/[^/]{{1,9}}')),
b AS (SELECT kind, min(page_no) AS bare FROM (SELECT kind, page_no + 1 AS page_no FROM (SELECT DISTINCT kind, page_no FROM l) UNION SELECT DISTINCT page_id % {KINDS}, 0 FROM pages) x
      WHERE (kind, page_no) NOT IN (SELECT kind, page_no FROM l) GROUP BY kind),
s AS (
  SELECT -1::BIGINT AS kind, []::STRUCT(kind BIGINT, page_no BIGINT, pos BIGINT, url VARCHAR, title VARCHAR)[] AS took
  UNION ALL
  SELECT s.kind + 1, list_concat(s.took, coalesce((
    WITH f AS (SELECT c.*, row_number() OVER (PARTITION BY url ORDER BY page_no, pos) AS nth FROM c JOIN b USING (kind)
               WHERE c.kind = s.kind + 1 AND page_no < bare AND NOT list_contains(list_transform(s.took, lambda t: t.url), url)),
    n AS (SELECT page_no FROM f WHERE nth = 1 GROUP BY page_no),
    e AS (SELECT min(page_no) AS page_no FROM (SELECT DISTINCT page_no FROM l WHERE kind = s.kind + 1 AND page_no > 2 AND page_no NOT IN (SELECT page_no FROM n)) y)
    SELECT list(struct_pack(kind := f.kind, page_no := f.page_no, pos := f.pos, url := f.url, title := f.title)) FROM f, e WHERE nth = 1 AND (e.page_no IS NULL OR f.page_no < e.page_no)
  ), []))
  FROM s WHERE s.kind < {KINDS - 1}
)
SELECT t.kind, t.page_no, t.pos, t.url, t.title, row_number() OVER (ORDER BY t.kind, t.page_no, t.pos) AS sequence FROM (SELECT unnest(took) AS t FROM s WHERE kind = {KINDS - 1})"""
)
def listing_crawl(spark, d):
    """SRC1, U3: listings of stored pages under the stop rules, first occurrences numbered."""
    pages = table(spark, d, "pages")
    at = [(F.col("page_id") % KINDS).alias("kind"), F.floor(F.col("page_id") / KINDS).alias("page_no")]
    found = corpus.page_links(pages).select(*at, "pos", X.url_without_query(F.col("href")).alias("url"), "title")
    counts = pages.select(*at).distinct().join(found.groupBy("kind", "page_no").agg(F.count("*").alias("n_links")), ["kind", "page_no"])
    got = crawl.listing_crawl(counts, found.where(F.col("url").rlike("^/[^/]{1,9}$")))
    return got.select("kind", "page_no", F.col("pos").cast("long"), "url", "title", "sequence")


@query(
    r"""WITH s AS (SELECT page_id, regexp_replace(html, '(?s)<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS plain FROM s"""
)
def plain_pages(spark, d):
    """Scalar functions on HTML: tags out, entities decoded, white space squeezed."""
    return table(spark, d, "pages").select("page_id", X.plain_html(F.col("html")).alias("plain"))


@query(r"SELECT page_id, regexp_replace(url, '[?#].*$', '') AS clean, list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')) AS file FROM pages")
def clean_urls(spark, d):
    """F9 parts: URLs without query, file names."""
    return table(spark, d, "pages").select("page_id", X.url_without_query(F.col("url")).alias("clean"), X.file_name(F.col("url")).alias("file"))


@query("SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9]', '-', 'g') AS slug, length(p_type) - length(replace(p_type, ' ', '')) + 1 AS level, nullif(regexp_extract(replace(p_type, ' ', '.'), '^(.*)\\.[^.]+$', 1), '') AS parent FROM part".replace("\\\\", "\\"))
def ids_and_levels(spark, d):
    """G5, F5, hierarchy of dotted references."""
    ref = F.replace(F.col("p_type"), F.lit(" "), F.lit("."))
    return table(spark, d, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"), X.ref_level(ref).cast("long").alias("level"), X.ref_parent(ref).alias("parent"))


# --- evaluation and sets ------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT count(*) AS total, count(*) AS passed, 1.0 AS rate FROM chunks")
def citation_round_trip(spark, d):
    """Chunks found again by their citation key."""
    c = chunks(spark, d).withColumn("paragraph_ref", F.col("sequence_no").cast("string")).withColumns({"section_path": F.lit(""), "page_start": F.lit(1)})
    return evaluate.round_trip(c)


@query(
    """WITH n AS (SELECT n_nationkey, n_regionkey FROM nation), c AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0)
SELECT n_regionkey AS version_id, count(DISTINCT n_nationkey) AS eligible, count(DISTINCT c_nationkey) AS covered, count(DISTINCT n_nationkey) - count(DISTINCT c_nationkey) AS missing, 0::BIGINT AS extra,
  round(count(DISTINCT c_nationkey) / count(DISTINCT n_nationkey), 4) AS coverage FROM n LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY 1"""
)
def section_coverage(spark, d):
    """Eligible sections against an outline."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("version_id"), F.col("n_nationkey").cast("string").alias("section_ref"), F.lit(None).cast("string").alias("document_region"))
    have = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").cast("string").alias("section_ref")).distinct().join(n.select("version_id", "section_ref"), "section_ref")
    return evaluate.outline_coverage(n, have)


@query(
    """WITH s AS (SELECT CASE WHEN n_nationkey % 7 = 0 THEN n_regionkey::VARCHAR ELSE n_regionkey || '.' || n_nationkey END AS r, n_nationkey FROM nation),
k AS (SELECT r, n_nationkey, CASE WHEN contains(r, '.') THEN split_part(r, '.', 1) END AS p FROM s)
SELECT n_nationkey::VARCHAR AS chunk_id, 'missing_parent_section' AS "check" FROM k WHERE p IS NOT NULL AND p NOT IN (SELECT r FROM s)"""
)
def hierarchy_checks(spark, d):
    """Rules of the section hierarchy."""
    n = table(spark, d, "nation")
    ref = F.when(F.col("n_nationkey") % 7 == 0, F.col("n_regionkey").cast("string")).otherwise(F.concat_ws(".", "n_regionkey", "n_nationkey"))
    c = n.select(F.lit(1).alias("version_id"), F.col("n_nationkey").cast("string").alias("chunk_id"), ref.alias("section_ref")).withColumns(
        {"section_level": X.ref_level(F.col("section_ref")), "parent_section_ref": X.ref_parent(F.col("section_ref")), "chunk_type": F.lit("paragraph"), "document_region": F.lit("body")}
    )
    return evaluate.hierarchy_failures(c)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_yet_labelled(spark, d):
    """Rows that a step has still to do."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    f"""WITH {EDGES} SELECT source, target, type FROM (SELECT DISTINCT source, target, type, 1 AS p FROM e WHERE type = 'amends' UNION ALL SELECT DISTINCT source, target, type, 0 FROM e WHERE type = 'replaces')
QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY p, type) = 1"""
)
def merged_edges(spark, d):
    """Overrides win over detected edges."""
    e = _edges(spark, d).distinct()
    return corpus.merge_edges(e.where("type = 'amends'"), e.where("type = 'replaces'"))


# --- sequential operators: tested on fixtures ------------------------------------------------


@query()
def paragraphize_pages(spark, d):
    """G1: chunks from the parts of conversations."""
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.lit("en").alias("language"), (F.col("turn") + 1).cast("int").alias("page_no"), "text")
    return segment.paragraphize(pages).select("document_id", "chunk_id", "sequence_no", "chunk_type", "document_region", "section_ref", "page_start")


@query()
def heuristic_outlines(spark, d):
    """Outlines folded from lines."""
    c = _sectioned(spark, d).select("version_id", "sequence_no", F.concat_ws(" ", "section_ref", F.substring("text", 1, 20)).alias("section_path"), F.lit(None).cast("string").alias("paragraph_ref"), "text", F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    return segment.heuristic_outline(c).select("version_id", "section_ref", "title", "level", "first_seq", "last_seq", "chunk_count")


@query()
def split_chunks(spark, d):
    """Oversized texts in pieces with dense sequence numbers."""
    rows = documents(spark, d).select("document_id", F.col("document_id").cast("string").alias("chunk_id"), F.lit(0).alias("sequence_no"), "text")
    return segment.split_long(rows, 1000).select("document_id", "chunk_id", "sequence_no", F.length("text").alias("n"))
