"""Listings, document ids and extraction as plans over stored pages and texts.

What a sequential crawler decides page by page is stated here over whole tables: which
links a listing yields under its stop rules, which id each document ends with and
which go to review, and which method gave a document's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.core import materialize
from quillspark.operators.corpus import REF

#: A listing ends with the first page after this one that has no new link.
PATIENCE = 2


def listing_crawl(pages: DataFrame, links: DataFrame, limit: int | None = None, patience: int = PATIENCE) -> DataFrame:
    """Links that a crawl of listings takes, in order: kind, page_no, pos, url, title, and ``sequence`` from 1.

    ``pages``: kind (listings are read in its order), page_no (from 0); ``links``: kind,
    page_no, pos, url, title, of candidates alone; ``pages`` also has ``n_links``, the
    number of a page's links of any sort. A page that isn't there or has no link ends its
    listing, and so does one beyond ``patience`` without a link that no listing has given
    before. Of a URL the first occurrence counts.

    Whether a link is new depends on where the listings before it ended. The ends are
    found by repetition: each round takes first occurrences among the pages that are
    left and sets the ends by them; after round n at least n listings have their true
    end, so it settles in as many rounds as there are listings, mostly in two or three.
    The driver holds one row a listing.
    """
    links = materialize(links.select("kind", "page_no", "pos", "url", "title"), "listing-links")
    kinds = pages.select("kind").distinct()
    # the first page that has no link or isn't there
    there = pages.where("n_links > 0").select("kind", "page_no").distinct()
    following = there.select("kind", (F.col("page_no") + 1).alias("page_no")).unionByName(kinds.withColumn("page_no", F.lit(0)))
    bare = following.select("kind", F.col("page_no").cast("long").alias("page_no")).join(there.withColumn("page_no", F.col("page_no").cast("long")), ["kind", "page_no"], "left_anti")
    limits = {r["kind"]: r["end"] for r in bare.groupBy("kind").agg(F.min("page_no").alias("end")).collect()}
    spark, ends = pages.sparkSession, dict(limits)
    known = materialize(there, "listing-pages")
    kind_type = dict(pages.dtypes)["kind"]

    def told(ends: dict) -> DataFrame:
        return F.broadcast(spark.createDataFrame(list(ends.items()), f"kind {kind_type}, end long"))

    def first(ends: dict) -> DataFrame:
        read = links.join(told(ends), "kind").where("page_no < end")
        best = read.groupBy("url").agg(F.min(F.struct("kind", "page_no", "pos", "title")).alias("x"))
        return best.select("x.*", "url")

    while True:
        new = first(ends).groupBy("kind", "page_no").agg(F.lit(True).alias("new")).distinct()
        stale = known.where(F.col("page_no") > patience).join(new, ["kind", "page_no"], "left_anti")
        # pages beyond an end had no chance to be new; they don't move it
        found = {r["kind"]: r["end"] for r in stale.join(told(ends), "kind").where("page_no < end").groupBy("kind").agg(F.min("page_no").alias("end")).collect()}
        again = {k: min(v, found.get(k, v)) for k, v in ends.items()}
        if again == ends:
            break
        ends = _reopened(again, ends, limits)
    taken = first(ends)
    order = [F.col(c) for c in ("kind", "page_no", "pos")]
    if limit is not None:
        taken = taken.orderBy(*order).limit(limit)
    # numbers over pages first, so that no window holds all links
    taken = materialize(taken, "listing-taken")
    counts = taken.groupBy("kind", "page_no").agg(F.count("*").alias("n"))
    ahead = counts.withColumn("ahead", F.sum("n").over(Window.orderBy("kind", "page_no")) - F.col("n")).drop("n")
    nth = F.row_number().over(Window.partitionBy("kind", "page_no").orderBy("pos"))
    return taken.withColumn("nth", nth).join(ahead, ["kind", "page_no"]).select("kind", "page_no", "pos", "url", "title", (F.col("nth") + F.col("ahead")).alias("sequence"))


def _reopened(again: dict, before: dict, limits: dict) -> dict:
    """Ends for the next round: up to the first listing whose end has moved they are true; those after it start anew."""
    moved = [k for k in again if again[k] != before[k]]
    least = min(moved, key=lambda k: (k is not None, k))
    return {k: again[k] if (k is not None, k) <= (least is not None, least) else limits[k] for k in again}


def generated_id(title: Column, url: Column, kind: Column, sequence: Column, authority: str, codes: dict[str, str]) -> Column:
    """The id that a title or URL states, else one made of the kind's code, the path's year and the number."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(url, F.lit("")))
    stated = F.replace(F.regexp_extract(text, REF, 1), F.lit("-"), F.lit("/"))
    code = F.lit("DOC")
    for k, v in codes.items():
        code = F.when(kind == k, v).otherwise(code)
    year = F.regexp_extract(F.coalesce(url, F.lit("")), r"/(20\d{2})-", 1)
    made = F.concat(F.lit(f"{authority}/LARGE-"), code, F.lit("/"), F.when(year == "", "0000").otherwise(year), F.lit("/"), F.lpad(sequence.cast("string"), F.greatest(F.length(sequence.cast("string")), F.lit(4)), F.lit("0")))
    return F.when(stated != "", stated).otherwise(made)


def claimed_ids(documents: DataFrame, generated: Column) -> DataFrame:
    """Each document's final id and whether it goes to review: adds final_id, confidence, reason, collides_with.

    ``documents``: position (their order, no ties), original_id, slug, refs (distinct
    references of the text, null: no text), picked (struct id, confidence: the reference
    that names the document). ``generated``: whether the original id was made up.

    A document with a real id keeps it if its text names any; a generated one takes
    the picked reference. The first to claim an id has it. Each later one gets /DUP and
    the number of earlier documents whose id starts with the claim, plus one, and is
    queued as a collision beside the first one's slug. Without a text or a reference
    there is no final id, and the document is queued. ``reason`` is null where nothing
    is to be reviewed.
    """
    picked = F.col("picked.id")
    claim = F.when(picked.isNotNull(), F.when(generated, picked).otherwise(F.col("original_id")))
    agrees = ~generated & (F.upper(picked) == F.upper(F.replace("original_id", F.lit("-"), F.lit("/"))))
    rows = documents.withColumns({"claim": claim, "was_generated": generated, "said": F.when(agrees, "high").otherwise(F.col("picked.confidence"))})
    rows = materialize(rows, "id-claims")
    # an id starts with a claim if it is the claim or the claim with more digits: each id under all of its own starts
    digits = F.length(F.regexp_extract("claim", r"(\d*)$", 1))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(digits - 1, F.lit(0))), lambda i: F.substring(F.col("claim"), F.lit(1), F.length("claim") - i))
    starts = rows.where("claim IS NOT NULL").select("position", "slug", "claim", F.explode(cut).alias("start"))
    by = Window.partitionBy("start").orderBy("position")
    own = F.col("claim") == F.col("start")
    earlier = F.count("*").over(by.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first(F.when(own, F.col("slug")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    nth = F.sum(own.cast("int")).over(by)
    counted = starts.withColumns({"earlier": earlier, "first": first, "nth": nth}).where(own).select("position", "earlier", "first", "nth")
    out = rows.join(counted, "position", "left")
    collides = F.coalesce(F.col("nth") > 1, F.lit(False))
    final = F.when(collides, F.concat("claim", F.lit("/DUP"), (F.col("earlier") + 1).cast("string"))).otherwise(F.col("claim"))
    confidence = F.when(collides & F.col("was_generated"), "low").otherwise(F.coalesce("said", F.lit("unresolved")))
    reason = F.when(F.col("refs").isNull(), "no text").when(F.col("claim").isNull(), "no reference in the text").when(collides, "collision")
    return out.select(*documents.columns, final.alias("final_id"), confidence.alias("confidence"), reason.alias("reason"), F.when(collides, F.col("first")).alias("collides_with"))


def extract_with_fallback(documents: DataFrame, done: DataFrame, primary: Column, fallback: Column, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(pages of documents that have a text, one row a document saying how it went).

    ``done``: keys that were extracted before; they are skipped. ``primary`` and
    ``fallback`` give a struct (pages array<struct>, error string) each; the second is
    asked where the first has an error. ``method``: primary, fallback, skipped or failed,
    with the errors of the methods that failed; of a key with several rows the least
    row by ``primary`` error and pages counts.
    """
    rows = documents.join(done.select(F.col(key).alias("_done")).distinct(), F.col(key).eqNullSafe(F.col("_done")), "left").withColumn("_was", F.col("_done").isNotNull()).drop("_done")
    first = rows.withColumn("_one", F.when(~F.col("_was"), primary))
    failed = ~F.col("_was") & F.col("_one.error").isNotNull()
    both = materialize(first.withColumn("_two", F.when(failed, fallback)), "extraction")
    method = F.when(F.col("_was"), "skipped").when(F.col("_one.error").isNull(), "primary").when(F.col("_two.error").isNull(), "fallback").otherwise("failed")
    told = both.withColumn("method", method)
    pages = told.where("method IN ('primary', 'fallback')").select(key, "method", F.explode(F.when(F.col("method") == "primary", F.col("_one.pages")).otherwise(F.col("_two.pages"))).alias("page"))
    report = told.select(key, "method", F.col("_one.error").alias("primary_error"), F.when(F.col("method") == "failed", F.col("_two.error")).alias("fallback_error"))
    return pages, report
