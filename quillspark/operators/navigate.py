"""Positions, sections, outlines, versions and life cycle: joins over ordered chunks and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.core import any_of

#: Edges that make the source stand for the target, best first.
ALIAS_PRIORITY = ("consolidates", "replaces", "supersedes")


def context(hits: DataFrame, chunks: DataFrame, before: int, after: int, version: str = "version_id", seq: str = "sequence_no", key: str = "chunk_id", rank: str = "rank", by: str = "query_id") -> DataFrame:
    """Neighbours of hits by sequence value; each chunk once a query, anchors first."""
    h = hits.select(by, F.col(rank).alias("anchor_rank"), F.col(version).alias("h_version"), F.col(seq).alias("h_seq"))
    near = h.join(chunks, (F.col("h_version") == F.col(version)) & F.col(seq).between(F.col("h_seq") - before, F.col("h_seq") + after))
    near = near.withColumn("is_context", (F.col(seq) != F.col("h_seq")).cast("int"))
    nth = F.row_number().over(Window.partitionBy(by, key).orderBy("is_context", "anchor_rank", seq))
    return near.withColumn("nth", nth).where("nth = 1").drop("nth", "h_version", "h_seq")


def section_chunks(sections: DataFrame, chunks: DataFrame, version: str = "version_id", seq: str = "sequence_no") -> DataFrame:
    """Chunks whose place lies in a section's range: an equi-join with a range residual."""
    s = sections.where("sequence_start IS NOT NULL AND sequence_end IS NOT NULL").withColumnRenamed(version, "s_version")
    return s.join(chunks, (F.col("s_version") == F.col(version)) & F.col(seq).between(F.col("sequence_start"), F.col("sequence_end"))).drop("s_version").distinct()


def outline(chunks: DataFrame, version: str = "version_id", seq: str = "sequence_no", regions: tuple[str, ...] | None = ("body", "annex")) -> DataFrame:
    """One row a section of ``regions`` (None: of all, whether chunks have regions or not): first title and ranges of pages and places."""
    ok = chunks.where(F.coalesce("section_ref", F.lit("")) != "")
    ok = ok if regions is None else ok.where(F.coalesce(F.col("document_region"), F.lit("body")).isin(*regions))
    first = [F.min_by(c, F.col(seq)).alias(a) for c, a in (("section_title", "title"), ("section_level", "level"), ("parent_section_ref", "parent_section_ref"), ("metadata_confidence", "confidence"))]
    return ok.groupBy(version, "section_ref").agg(
        *first, F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.min(seq).alias("sequence_start"), F.max(seq).alias("sequence_end")
    )


def outline_order() -> list[Column]:
    return [F.coalesce("sequence_start", F.lit(2**31 - 1)), F.col("level"), F.col("section_ref")]


def chunk_summary(chunks: DataFrame, by: list[str], ref: str = "paragraph_ref", seq: str = "sequence_no") -> DataFrame:
    """Distinct references in order of first place, ranges and counts."""
    refs = F.array_sort(F.collect_list(F.when(F.coalesce(F.col(ref), F.lit("")) != "", F.struct(F.col(seq).alias("s"), F.col(ref).alias("r")))))
    return chunks.groupBy(*by).agg(F.array_distinct(F.transform(refs, lambda x: x["r"])).alias("paragraph_refs"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count("*").alias("chunk_count"))


#: Phrases of consultation material in titles and first lines (fixed values).
BOILERPLATE = ("do you have any comments", "feedback on", "summary of responses", "public consultation", "analysis of responses", "consultation responses")


def is_boilerplate(title: str = "section_title", path: str = "section_path", text: str = "text") -> Column:
    """Whether a chunk's title (its path if it has none) or first line holds one of the phrases."""
    plain = lambda c: F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", " "))
    shown = plain(F.when(F.coalesce(title, F.lit("")) != "", F.col(title)).otherwise(F.col(path)))
    first = plain(F.substring_index(F.coalesce(text, F.lit("")), "\n", 1))
    return any_of([F.contains(x, F.lit(p)) for p in BOILERPLATE for x in (shown, first)])


def sanitize_sections(chunks: DataFrame, boilerplate: Column, version: str = "version_id") -> DataFrame:
    """Clears section metadata on boilerplate rows, then parents that no row of the version
    has, with confidence at most 0.85. Rows without a section stay as they are. References
    are only ever taken away, so two passes reach the fixpoint."""
    has = F.coalesce("section_ref", F.lit("")) != ""
    gone = has & F.coalesce(boilerplate, F.lit(False))
    cleared = {c: F.when(~F.col("gone"), F.col(c)) for c in ("section_ref", "section_title", "section_level", "parent_section_ref")}
    if "section_path" in chunks.columns:
        cleared["section_path"] = F.when(F.col("gone"), "").otherwise(F.col("section_path"))
    one = chunks.withColumn("gone", gone).withColumns(cleared).drop("gone")
    refs = one.where(has).select(F.col(version).alias("r_version"), F.col("section_ref").alias("r_ref"), F.lit(True).alias("there")).distinct()
    two = one.join(refs, (F.col(version) == F.col("r_version")) & (F.col("parent_section_ref") == F.col("r_ref")), "left")
    dangling = has & (F.coalesce("parent_section_ref", F.lit("")) != "") & F.col("there").isNull()
    capped = F.least(F.coalesce("metadata_confidence", F.lit(0.85)), F.lit(0.85))
    two = two.withColumn("dangling", dangling).withColumns({"metadata_confidence": F.when(F.col("dangling"), capped).otherwise(F.col("metadata_confidence")), "parent_section_ref": F.when(~F.col("dangling"), F.col("parent_section_ref"))})
    return two.drop("r_version", "r_ref", "there", "dangling")


def best_alias(edges: DataFrame, known: DataFrame, priority: tuple[str, ...] = ALIAS_PRIORITY) -> DataFrame:
    """(target, source): the document that stands for a target, one hop away.

    ``edges``: source, target, type; ``known``: document_id, published_at.
    """
    rank = F.coalesce(*(F.when(F.col("type") == t, i) for i, t in enumerate(priority)))
    ok = edges.where(F.col("type").isin(*priority) & (F.col("source") != F.col("target"))).join(known.select(F.col("document_id").alias("source"), "published_at"), "source")
    order = Window.partitionBy("target").orderBy(rank, F.desc(F.coalesce("published_at", F.lit(""))), F.desc("source"))
    return ok.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("target", "source")


def resolve(ids: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    a = aliases.select(F.col("target").alias("a_target"), F.col("source").alias("a_source"))
    return ids.join(a, F.col(column) == F.col("a_target"), "left").withColumn(column, F.coalesce("a_source", column)).drop("a_target", "a_source")


def lifecycle(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents with the sources of their reverse edges and the flags that follow."""
    back = edges.groupBy("target").agg(
        F.array_sort(F.collect_set(F.when(F.col("type") == "amends", F.col("source")))).alias("amended_by"),
        F.array_sort(F.collect_set(F.when(F.col("type").isin("supersedes", "replaces", "repeals"), F.col("source")))).alias("superseded_by"),
    )
    none = F.array().cast(dict(back.dtypes)["amended_by"])
    out = documents.join(back, documents["document_id"] == back["target"], "left").drop("target")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("amended_by", "superseded_by")})
    return out.withColumn("is_consultation", F.lower("publication_status").contains("consultation")).withColumn("is_partially_superseded", (F.size("amended_by") > 0) & (F.size("superseded_by") == 0))


def latest_version(versions: DataFrame, by: str = "document_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("is_current"), F.desc("published_at"), F.desc("version_id"))
    return versions.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def diff_versions(pairs: DataFrame, versions: DataFrame, fields: tuple[str, ...] = ("published_at", "file_sha256", "is_current")) -> DataFrame:
    """(document_id, field, old, new) for the fields that differ; null counts as empty.

    ``pairs``: document_id, from_version, to_version.
    """
    def side(label: str, name: str) -> DataFrame:
        cells = F.array(*(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))
        return versions.select(F.col("document_id").alias(f"{name}_id"), F.col("version_id").alias(label), cells.alias(name))

    old = side("o_version", "old")
    new = side("n_version", "new")
    got = pairs.join(old, (F.col("document_id") == F.col("old_id")) & (F.col("from_version") == F.col("o_version"))).join(new, (F.col("document_id") == F.col("new_id")) & (F.col("to_version") == F.col("n_version")))
    cells = F.explode(F.arrays_zip(F.array(*map(F.lit, fields)).alias("field"), F.col("old"), F.col("new")))
    return got.select("document_id", cells.alias("c")).select("document_id", "c.field", "c.old", "c.new").where("old <> new")


def validate_citations(cited: DataFrame, chunks: DataFrame, status: DataFrame) -> DataFrame:
    """Each cited chunk id with what it names: no alias is followed.

    ``chunks``: chunk_id, document_id; ``status``: document_id, superseded (boolean).
    """
    got = cited.join(chunks.select(F.col("chunk_id").alias("k"), "document_id"), F.col("chunk_id") == F.col("k"), "left").drop("k")
    got = got.join(status, "document_id", "left")
    return got.withColumn("exists", F.col("document_id").isNotNull()).withColumn("current", F.col("document_id").isNotNull() & ~F.coalesce("superseded", F.lit(False)))
