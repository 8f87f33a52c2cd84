"""Stored corpora that queries read: chunks and keyword indexes, built once a set of source files.

What is built lies in the shared folder under the source files' fingerprint (paths,
sizes and times), as a table under snapshots: queries of any session read it, and two
that build it at once end with one of both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.core import materialize, shared_dir
from quillspark.operators import filters, search
from quillspark.sources.snapshots import Conflict, SnapshotTable

#: Raised whenever what is stored changes its form.
FORMAT = 1
#: Fields that a search can filter by equality.
FILTERS = ("document_id", "document_type", "topic", "publication_status", "applicability_status", "language")
#: The mark of chunks that aren't consultation material.
PLAIN = "@kind:plain"


def fingerprint(source: DataFrame) -> str:
    """Of the files that ``source`` reads; no column of theirs is read."""
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    got = files.agg(F.sum(F.xxhash64("*").cast("decimal(38,0)")), F.count("*")).first()
    return f"{got[1]}-{int(got[0] or 0) & (1 << 64) - 1:016x}"


def stored(source: DataFrame, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of ``source``'s files; ``make`` gives its rows if it isn't there."""
    spark = source.sparkSession
    at = SnapshotTable(spark, f"{shared_dir(spark)}/quillspark/corpus/{name}-{FORMAT}-{fingerprint(source)}")
    if at.snapshot()["schema"] is None:
        try:
            at.replace(make())
        except Conflict:  # another session has just built it
            pass
    return at.read()


def by_term(index: DataFrame) -> DataFrame:
    """Index rows that are clustered and sorted by term, so that files and row groups without an asked term are passed over.

    The lists of a frequent term, one a shard, may go to several files.
    """
    return materialize(index, "index-shards").repartitionByRange("term", "shard").sortWithinPartitions("term", "shard")


def chunk_marks(columns: list[str]) -> list[Column]:
    """Marks of the fields among ``columns`` that searches filter by."""
    marks = [search.mark(f, F.col(f)) for f in FILTERS if f in columns]
    if "title" in columns and "topic" in columns:  # a topic that stands for titles as well
        marks += [F.when(filters.topic(t) & (F.coalesce("topic", F.lit("")) != t), search.mark("topic", F.lit(t))) for t in filters.TOPIC_TERMS]
    if "section_path" in columns:
        marks.append(F.when(filters.not_consultation(), F.lit(PLAIN)))
    return marks


def asked_marks(columns: list[str]) -> list[Column]:
    """Marks that requests with these columns ask for; a null or empty field filters nothing."""
    given = lambda f: F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.col(f))
    marks = [search.mark(f, given(f)) for f in FILTERS if f in columns and f != "topic"]
    if "topic" in columns:
        upper = F.upper("topic")
        marks.append(search.mark("topic", F.when(upper.isin(*filters.TOPIC_TERMS), upper).otherwise(given("topic"))))
    if "exclude_consultation" in columns:
        marks.append(F.when(F.col("exclude_consultation"), F.lit(PLAIN)))
    return marks
