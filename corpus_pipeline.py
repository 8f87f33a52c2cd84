"""A training-data pipeline over ``documents``: quality, near duplicates, benchmark
passages, source mixture, token records.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. Stages
find rows by a key of all columns, so rows with equal keys are equal.

Defined results: nulls are values like others; an empty or null text fails the
quality rules; repeated rows fare alike in every stage, one of them stays in the
second, and the fourth may take a row more than once; of near duplicates the least
id stays, then the least key; ids that aren't whole numbers are null in the last
stage; an empty table gives an empty table; columns beyond those of ``documents``
are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.core import materialize, table
from quillspark.llm import bagminhash, decontam, mixing, quality, queries, records

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    # no part is null, so keys can be compared with plain equality
    def text(x: str):
        return F.coalesce(F.concat(F.lit("="), F.col(x).cast("string")), F.lit(""))

    digest = F.coalesce(F.md5(F.encode("text", "UTF-8")), F.lit(""))
    key = F.concat_ws("\x00", text("doc_id"), digest, text("lang"), text("source"), text("n_chars"))
    return docs.select(*COLUMNS).withColumn("row_key", F.sha2(key, 256))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    rows = _keyed(docs)
    verdicts = quality.quality_verdicts(rows, doc_id="row_key")
    # the rejected are the fewer; equal rows share a verdict
    rejected = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("row_key")).distinct()
    return rows.join(rejected, "row_key", "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the least id."""
    rows = _keyed(docs)
    ids = rows.select(F.struct("doc_id", "row_key").alias("id"), "text")
    classes = bagminhash.near_duplicates(ids, doc_id="id")
    kept = classes.groupBy("class").agg(F.min("doc_id").alias("id")).select(F.col("id.row_key").alias("row_key"))
    return rows.join(kept, "row_key").dropDuplicates(["row_key"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage."""
    rows = _keyed(docs)
    found = decontam.contamination(rows, table(spark, sf_dir, "benchmark"), doc_id="row_key")
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("row_key")).distinct()
    return rows.join(hit, "row_key", "left_anti").select(*COLUMNS)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them, in the order of its shards and places."""
    rows = _keyed(docs)
    draws, _ = mixing.mix(rows, doc_id="row_key")
    drawn = draws.select(F.col("doc_id").alias("row_key"), "shard", "place")
    taken = rows.dropDuplicates(["row_key"]).join(drawn, "row_key")
    return taken.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").select(*COLUMNS)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, written in the record format and read back.

    Rows of a stored table keep the order of its files, which is that of the mixture's shards and
    places; others go by id.
    """
    stored = [F.col("_metadata.file_name"), F.col("_metadata.row_index")] if docs.inputFiles() else None
    return records.encode_documents(docs, queries.byte_tokenizer(), end_id=0, order=stored)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixture),
    ("token-ID / binary output", token_records),
]

#: Robust estimates, Poisson signatures and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k + 1}")
    return docs
