"""Evaluation of retrieval and of the corpus's structure, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import ref_level, ref_parent

CHUNK_TYPES = ("paragraph", "heading", "table", "annex", "footnote", "front_matter", "back_matter", "consultation_response")
REGIONS = ("front_matter", "body", "annex", "back_matter", "consultation_feedback")


def retrieval_scores(hits: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 10, by: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """One row: mean reciprocal rank and recall at ``k``; a query without a relevant hit counts 0."""
    best = hits.join(relevant, [by, key], "left_semi").groupBy(by).agg(F.min("rank").alias("rank"))
    each = queries.select(by).distinct().join(best, by, "left")
    return each.agg(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias("recall"), F.count("*").alias("queries"))


def round_trip(chunks: DataFrame, doc: str = "document_id") -> DataFrame:
    """One row: chunks found again by their citation key, and their share."""
    key = F.when(F.coalesce("paragraph_ref", F.lit("")) != "", F.concat(F.lit("r:"), F.col("paragraph_ref"))).otherwise(F.concat(F.lit("s:"), F.col("section_path"), F.lit(":"), F.col("page_start").cast("string")))
    rows = chunks.select(doc, "language", "chunk_id", key.alias("cite"))
    again = rows.select(F.col(doc).alias("d"), F.col("language").alias("l"), F.col("chunk_id").alias("c"), F.col("cite").alias("k")).distinct()
    found = rows.join(again, (F.col(doc) == F.col("d")) & (F.col("language") == F.col("l")) & (F.col("chunk_id") == F.col("c")) & (F.col("cite") == F.col("k")), "left")
    return found.agg(F.count("*").alias("total"), F.count("c").alias("passed"), F.round(F.count("c") / F.greatest(F.count("*"), F.lit(1)), 4).alias("rate"))


def cyclic_sections(refs: DataFrame, doublings: int = 6) -> DataFrame:
    """(r_version, r_ref, cyclic): sections whose parents, followed up, never end.

    ``refs`` has r_version, r_ref and r_parent. Paths double in each join, so chains of
    2 ** ``doublings`` levels and more count as cycles.
    """
    up = refs.select("r_version", "r_ref", F.col("r_parent").alias("above"))
    for _ in range(doublings):
        further = up.select(F.col("r_version").alias("u_version"), F.col("r_ref").alias("u_ref"), F.col("above").alias("u_above"))
        up = up.join(further, (F.col("r_version") == F.col("u_version")) & (F.col("above") == F.col("u_ref")), "left").select("r_version", "r_ref", F.col("u_above").alias("above"))
    return up.select("r_version", "r_ref", F.col("above").isNotNull().alias("cyclic"))


def hierarchy_failures(chunks: DataFrame, version: str = "version_id") -> DataFrame:
    """(chunk_id, check) for every structural rule that a chunk breaks."""
    rows = chunks.withColumn("has", F.coalesce("section_ref", F.lit("")) != "")
    refs = rows.where("has").select(F.col(version).alias("r_version"), F.col("section_ref").alias("r_ref"), F.col("section_level").alias("r_level"), F.col("parent_section_ref").alias("r_parent")).groupBy("r_version", "r_ref").agg(F.min("r_level").alias("r_level"), F.min("r_parent").alias("r_parent"))
    own = cyclic_sections(refs.where("r_parent <> ''")).select(F.col("r_version").alias("c_version"), F.col("r_ref").alias("c_ref"), "cyclic")
    rows = rows.join(own, (F.col(version) == F.col("c_version")) & (F.col("section_ref") == F.col("c_ref")), "left")
    both = rows.join(refs, (F.col(version) == F.col("r_version")) & (F.col("parent_section_ref") == F.col("r_ref")), "left")
    numeric = F.col("section_ref").rlike(r"^\d+(\.\d+)*$")
    parent = F.col("parent_section_ref").isNotNull()
    checks = F.array(
        F.when(~F.coalesce("chunk_type", F.lit("")).isin(*CHUNK_TYPES), "invalid_chunk_type"),
        F.when(F.col("document_region").isNotNull() & ~F.col("document_region").isin(*REGIONS), "invalid_region"),
        F.when(F.col("has") & numeric & ~F.col("section_level").eqNullSafe(ref_level(F.col("section_ref"))), "level_mismatch"),
        F.when(F.col("has") & numeric & ~F.col("parent_section_ref").eqNullSafe(ref_parent(F.col("section_ref"))), "parent_ref_mismatch"),
        F.when(F.col("has") & parent & F.col("r_ref").isNull(), "missing_parent_section"),
        F.when(F.col("has") & F.col("r_ref").isNotNull() & (F.col("section_level") != F.col("r_level") + 1), "level_gap"),
        F.when(F.col("has") & F.col("cyclic"), "cycle"),
    )
    return both.select("chunk_id", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("check"))


def outline_coverage(chunks: DataFrame, outline: DataFrame, version: str = "version_id") -> DataFrame:
    """A row a version: sections of body and annex chunks that the outline has or lacks, and extra ones."""
    region = F.coalesce("document_region", F.lit("body")).isin("body", "annex")
    want = chunks.where(region & (F.coalesce("section_ref", F.lit("")) != "")).select(version, "section_ref").distinct().withColumn("want", F.lit(1))
    have = outline.select(version, "section_ref").distinct().withColumn("have", F.lit(1))
    both = want.join(have, [version, "section_ref"], "full_outer")
    covered = F.sum(F.when(F.col("want").isNotNull() & F.col("have").isNotNull(), 1).otherwise(0))
    return both.groupBy(version).agg(
        F.count("want").alias("eligible"), covered.alias("covered"), F.sum(F.when(F.col("have").isNull(), 1).otherwise(0)).alias("missing"), F.sum(F.when(F.col("want").isNull(), 1).otherwise(0)).alias("extra"),
        F.round(covered / F.greatest(F.count("want"), F.lit(1)), 4).alias("coverage"),
    )


def navigation_differences(shown: DataFrame, stored: DataFrame, version: str = "version_id") -> DataFrame:
    """Sections whose shown range differs from the stored one, or that one side lacks."""
    a = shown.select(version, "section_ref", F.col("sequence_start").alias("a_start"), F.col("sequence_end").alias("a_end"))
    b = stored.select(version, "section_ref", F.col("sequence_start").alias("b_start"), F.col("sequence_end").alias("b_end"))
    both = a.join(b, [version, "section_ref"], "full_outer")
    return both.where(~(F.col("a_start").eqNullSafe(F.col("b_start")) & F.col("a_end").eqNullSafe(F.col("b_end"))))


def failure_counts(failures: DataFrame, kind: str = "check") -> DataFrame:
    """How often each check fails."""
    return failures.groupBy(kind).agg(F.count("*").alias("n"))


def span_confidence(chunks: DataFrame, by: list[str], confidence: str = "metadata_confidence") -> DataFrame:
    """Least, mean and greatest confidence of each span, and its rows."""
    return chunks.groupBy(*by).agg(F.min(confidence).alias("lo"), F.avg(confidence).alias("mean"), F.max(confidence).alias("hi"), F.count("*").alias("n"))


def judge_fixtures(fixtures: DataFrame, answers: DataFrame, citations: DataFrame, needed: tuple[str, ...] = ("citation_id", "document_id", "text", "citation", "page_start")) -> DataFrame:
    """(fixture_id, reasons, passed): what each fixture's answer fails to meet.

    ``fixtures``: fixture_id, tool, expected_answerability, expected_min_results,
    expected_document_id, nulls for what isn't stated. ``answers``: fixture_id,
    answerability. ``citations``: fixture_id, document_id and other columns; a ``needed``
    column that is absent fails a fixture with citations. Fixtures of tools other than
    search need an answer alone. Citations are counted before the join.
    """
    absent = [c for c in needed if c not in citations.columns]
    want = fixtures.select(
        "fixture_id", F.coalesce("tool", F.lit("search")).alias("tool"), F.coalesce("expected_answerability", F.lit("partial")).alias("want"), "expected_min_results", F.col("expected_document_id").alias("wanted_document")
    ).withColumn("least", F.coalesce("expected_min_results", F.when(F.col("want") == "no_match", 0).otherwise(1)))
    rows = citations.select("fixture_id", F.col("document_id").cast("string").alias("document_id")).join(want.select("fixture_id", "wanted_document"), "fixture_id")
    n = rows.groupBy("fixture_id").agg(F.count("*").alias("n"), F.coalesce(F.max(F.col("document_id") == F.col("wanted_document")), F.lit(False)).alias("found"))
    both = want.join(answers.select("fixture_id", F.coalesce("answerability", F.lit("none")).alias("got")), "fixture_id", "left").join(n, "fixture_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    search = F.col("tool") == "search"
    checks = F.array(
        F.when(F.col("got").isNull(), "no answer"),
        F.when(search & (F.col("got") != F.col("want")), F.concat(F.lit("expected answerability "), "want", F.lit(", got "), "got")),
        F.when(search & (F.col("n") < F.col("least")), F.concat(F.lit("expected at least "), F.col("least").cast("string"), F.lit(" results, got "), F.col("n").cast("string"))),
        F.when(search & (F.col("n") > 0) & F.col("wanted_document").isNotNull() & ~F.col("found"), F.concat(F.lit("expected document "), "wanted_document", F.lit(" not in results"))),
        F.when(search & (F.col("want") == "no_match") & (F.col("n") > 0), "expected zero citations"),
        F.when(search & (F.col("n") > 0) & F.lit(bool(absent)), "missing citation fields " + ", ".join(absent)),
    )
    return both.select("fixture_id", F.filter(checks, lambda c: c.isNotNull()).alias("reasons")).withColumn("passed", F.size("reasons") == 0)


def tagged(fixtures: DataFrame, tags: list[str], column: str = "tags") -> DataFrame:
    """Fixtures with any of the tags; all of them if none is asked for."""
    return fixtures.where(F.arrays_overlap(column, F.array(*map(F.lit, tags)))) if tags else fixtures


def compare_modes(fixtures: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """(mode, mrr, recall, queries): how well each mode of search finds what fixtures expect.

    ``fixtures``: query_id, expected_documents and expected_refs (arrays; null or empty: any
    will do). ``hits``: mode, query_id, rank, document_id, paragraph_ref. A query without
    hits in a mode counts 0 there; every mode is averaged over all fixtures.
    """
    fits = lambda wanted, c: (F.coalesce(F.size(wanted), F.lit(0)) <= 0) | F.coalesce(F.array_contains(wanted, F.col(c)), F.lit(False))
    want = fixtures.select("query_id", "expected_documents", "expected_refs")
    good = hits.join(want, "query_id").where(fits("expected_documents", "document_id") & fits("expected_refs", "paragraph_ref"))
    best = good.groupBy("mode", "query_id").agg(F.min("rank").alias("best"))
    every = hits.select("mode").distinct().join(F.broadcast(fixtures.agg(F.count("*").alias("queries"))))  # one row
    sums = best.groupBy("mode").agg(F.sum(1.0 / F.col("best")).alias("rr"), F.count_if(F.col("best") <= k).alias("found"))
    each = every.join(sums, "mode", "left")
    return each.select("mode", F.coalesce(F.col("rr") / F.col("queries"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("found") / F.col("queries"), F.lit(0.0)).alias("recall"), "queries")


def pass_rates(results: DataFrame, by: list[str], passed: str = "passed") -> DataFrame:
    """(by, total, passed, rate) of judged rows; the rate has four digits."""
    return results.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"), F.round(F.count_if(passed) / F.count("*"), 4).alias("rate"))
