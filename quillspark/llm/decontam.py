"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts become words (letters A to Z lower-cased). Each text's k-word hashes slide
through windows of w hashes and the least hash of each window is kept. Training
and test texts that share ``span`` = k + w - 1 words share a kept hash, so joining
kept hashes finds every such span; a hit is then extended to all windows of
``span`` words that hold it, comparing the words themselves. Items with fewer than
``span`` words are single windows: hashes of exactly their lengths are looked up
at every position.

Scale: one pass over the documents and one shuffle of a row a document and hit.
Test fingerprints, each a hash and at most 2 * span words, are broadcast if there
are at most ``broadcast_rows`` of them. Larger test sets are joined by a shuffle of
(fingerprint, document) and only documents with a candidate are read again, so the
number of passes doesn't grow with the test set. Hits carry a short context and no
text. All rows of a document are grouped by its id and text; rows that repeat are
counted and given back as often.

Defined results: a null or empty text has no words and no hits; a null item id
counts as an empty string; repeated items count once; an empty document table gives
an empty table and an empty test table leaves all documents clean; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.core import join_on, materialize

#: A word in either case: digits, letters and every character that isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Low bits of a fingerprint hold the position, the others the hash. A string has
#: fewer than 2^31 bytes and a word takes two with its separator, so 30 bits hold
#: every position; hashes only propose, words decide.
POS_BITS = 30
POS_MASK = (1 << POS_BITS) - 1
#: Marks the one row that stands for the document itself; no hash equals it, for its low bits are set.
SELF = -1


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def fold(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def _gram_hash(hashes: Column, i: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *(F.get(hashes, i + j) for j in range(n))).bitwiseAND(F.lit(~POS_MASK))


def _grams(n: int) -> Column:
    """(hash, position) of all n-word runs, packed; ``hashes`` holds word hashes."""
    h = F.col("hashes")
    # hashes is named several times, which keeps the optimizer from computing it anew for each element
    packed = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: _gram_hash(h, i, n).bitwiseOR(i.cast("long")))
    return F.when(F.size(h) >= n, packed).otherwise(F.array().cast("array<bigint>"))


def _winnowed(grams: str, w: int) -> Column:
    g = F.col(grams)
    least = F.transform(F.sequence(F.lit(1), F.size(g) - w + 1), lambda i: F.array_min(F.slice(g, i, w)))
    return F.when(F.size(g) >= w, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def _with_fingerprints(df: DataFrame, k: int, w: int, shorter: list[int], whole: bool) -> DataFrame:
    """Adds ``prints``. ``whole``: runs of the shorter lengths only where they are the whole text."""
    df = df.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(F.lower(x)))).withColumn("grams", _grams(k))
    prints = _winnowed("grams", w)
    for n in shorter:
        runs = _grams(n)
        prints = F.concat(prints, F.when(F.size("hashes") == n, runs).otherwise(F.array().cast("array<bigint>")) if whole else runs)
    return df.withColumn("prints", prints).drop("hashes", "grams")


def test_fingerprints(items: DataFrame, span: int, k: int, item_id: str, text: str) -> tuple[DataFrame, list[int]]:
    """(fp, item_id, size of the window, offset, context words) and the lengths of short items."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    rows = materialize(rows, "decontam-items")
    n = F.size("words")
    # as many values as span has at most
    shorter = sorted(r["n"] for r in rows.where(n < span).select(n.alias("n")).distinct().collect())
    rows = _with_fingerprints(rows, k, span - k + 1, shorter, whole=True)
    rows = rows.withColumn("print", F.explode_outer("prints")).where(F.col("print").isNotNull()).withColumn("q", F.col("print").bitwiseAND(F.lit(POS_MASK)).cast("int"))
    window = F.least(n, F.lit(span))
    lead = F.least(F.col("q"), F.when(n < span, 0).otherwise(span - k))
    context = F.transform(F.slice("words", F.col("q") - lead + 1, lead + window), fold)
    return (
        rows.select(F.col("print").bitwiseAND(F.lit(~POS_MASK)).alias("fp"), "item_id", window.alias("window"), lead.alias("lead"), context.alias("context")).distinct(),
        shorter,
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    span: int = 10,
    k: int = 6,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_rows: int = 50_000,
) -> DataFrame:
    """A row a document: doc_id, n_words, n_hit, items (sorted), starts of hit windows.

    ``starts`` holds structs (at, window) in words.
    """
    prints, shorter = test_fingerprints(items, span, k, item_id, item_text)
    prints = materialize(prints, "decontam-prints")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("digest"), words_of(F.col(text)).alias("words"))
    marked = _with_fingerprints(rows, k, span - k + 1, shorter, whole=False)
    near = _by_broadcast(marked, prints) if prints.count() <= broadcast_rows else _by_shuffle(rows, marked, prints)
    found = _extended(near)
    got = found.groupBy("doc_id", "digest").agg(
        F.sum("is_self").alias("copies"),
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("is_self") == 0, F.struct("at", "window"))).alias("starts"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["at"], s["at"] + s["window"] - 1))))
    got = got.select("doc_id", "digest", "n_words", F.size(covered).cast("long").alias("n_hit"), "items", "starts", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return got.drop("digest", "copy")


def _by_broadcast(marked: DataFrame, prints: DataFrame) -> DataFrame:
    """Candidates and one row SELF a document, in one pass; ``prints`` must be small."""
    marked = marked.withColumn("prints", F.concat(F.col("prints"), F.array(F.lit(SELF).cast("long"))))
    itself = marked.sparkSession.range(1).select(F.lit(SELF).cast("long").alias("fp"), F.lit(None).cast("string").alias("item_id"), F.lit(0).alias("window"), F.lit(0).alias("lead"), F.array().cast("array<string>").alias("context"))
    # the outer form keeps the optimizer from testing the array's size, which computes all of it once more
    marked = marked.withColumn("print", F.explode_outer("prints"))
    fp = F.when(F.col("print") == SELF, F.col("print")).otherwise(F.col("print").bitwiseAND(F.lit(~POS_MASK)))
    # at most broadcast_rows rows of at most 2 * span words
    return marked.withColumn("doc_fp", fp).join(F.broadcast(prints.unionByName(itself)), F.col("doc_fp") == F.col("fp"))


def _by_shuffle(rows: DataFrame, marked: DataFrame, prints: DataFrame) -> DataFrame:
    """The same rows; fingerprints move with names of documents, words only for documents with a candidate."""
    # the outer form, as above
    slim = marked.select("doc_id", "digest", F.explode_outer("prints").alias("print")).withColumn("doc_fp", F.col("print").bitwiseAND(F.lit(~POS_MASK)))
    met = materialize(slim.join(prints, F.col("doc_fp") == F.col("fp")).drop("doc_fp", "fp"), "decontam-met")
    # repeated documents have met the same; each candidate needs their words once
    met = met.distinct()
    named = join_on(rows, met.select("doc_id", "digest").distinct(), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    none = {"print": F.lit(SELF).cast("long"), "item_id": F.lit(None).cast("string"), "window": F.lit(0), "lead": F.lit(0), "context": F.array().cast("array<string>")}
    return join_on(met, named, ["doc_id", "digest"]).unionByName(rows.withColumns(none))


def _extended(near: DataFrame) -> DataFrame:
    """Candidates whose words agree over a whole window, by the window's start, and SELF rows."""
    p = F.col("print").bitwiseAND(F.lit(POS_MASK)).cast("int")
    back = F.least(F.col("lead"), p)
    here = F.transform(F.slice("words", p - back + 1, back + F.col("window")), fold)
    hit = near.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), "item_id", "window", "lead", "context", F.when(F.col("print") == SELF, -1).otherwise(p).alias("p"), back.alias("back"), here.alias("here"))
    # a window that starts r words ahead of the matching run, in both texts
    agree = F.filter(
        F.sequence(F.lit(0), F.col("back")),
        lambda r: (F.size("here") >= F.col("back") - r + F.col("window"))
        & (F.size("context") >= F.col("lead") - r + F.col("window"))
        & (F.slice("here", F.col("back") - r + 1, F.col("window")) == F.slice("context", F.col("lead") - r + 1, F.col("window"))),
    )
    is_self = F.col("p") < 0
    ahead = F.explode_outer(F.when(is_self, F.array(F.lit(0))).otherwise(agree))
    return hit.select("doc_id", "digest", "n_words", "item_id", "window", "p", ahead.alias("ahead")).where(F.col("ahead").isNotNull()).select(
        "doc_id", "digest", "n_words", "item_id", "window", (F.col("p") - F.col("ahead")).alias("at"), F.when(is_self, 1).otherwise(0).alias("is_self")
    )
