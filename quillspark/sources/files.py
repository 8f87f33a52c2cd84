"""Readers and writers of a corpus's files."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.core import any_of
from quillspark.sources.snapshots import SnapshotTable

PAGE = "page_no int, text string, extraction_method string, char_count int"
DOWNLOAD = "url string, file_sha256 string, file_path string, title string, document_type string, publication_url string, published_at string, downloaded_at string, status string, notes string"
SEED = "document_id string, title string, document_type string, topic string, file_url string, publication_url string, language string, published_at string, publication_status string, applicability_status string, notes string"


def read_pages(spark: SparkSession, pattern: str) -> DataFrame:
    """Page records of ``<dir>/<slug>/pages.json`` files, with the slug."""
    rows = spark.read.schema(PAGE).option("multiLine", True).json(pattern)
    return rows.withColumn("slug", F.element_at(F.split(F.input_file_name(), "/"), -2))


def read_binary(spark: SparkSession, pattern: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Content-addressed files: path, file_sha256, length. ``allowed``: parts of which a path must have one."""
    rows = spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("file_sha256"), "length")
    for_one = [F.contains("path", F.lit(a)) for a in allowed]
    return rows.where(any_of(for_one)) if for_one else rows


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """A YAML seed list in any store that Spark reads; its size is that of one file on the driver."""
    import yaml

    names = [x.split()[0] for x in SEED.split(", ")]
    body = spark.read.text(path, wholetext=True).first()
    listed = (yaml.safe_load(body["value"] if body else "") or {}).get("documents") or []
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in listed], SEED)


def append_manifest(new: DataFrame, path: str) -> None:
    """Appends download records that the JSON lines at ``path`` don't hold; malformed lines there are ignored."""
    spark = new.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    rows = new.dropDuplicates(["file_sha256"])
    if there:
        rows = rows.join(read_manifest(spark, path).select("file_sha256").distinct(), "file_sha256", "left_anti")
    rows.write.mode("append").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOWNLOAD).option("mode", "DROPMALFORMED").json(path)


def write_table(df: DataFrame, path: str, cluster: list[str] | None = None, sort: list[str] | None = None) -> None:
    """Full rebuild of a table; rows of a cluster lie together, sorted, for pruning by file statistics."""
    if cluster:
        df = df.repartition(*(F.col(c) for c in cluster)).sortWithinPartitions(*cluster, *(sort or []))
    df.write.mode("overwrite").parquet(path)


def replace_versions(new: DataFrame, versions: DataFrame, path: str, by: str = "version_id") -> DataFrame:
    """Rows of ``versions`` are deleted from the table at ``path`` and ``new`` is inserted, in one
    step; gives the table. It lies under snapshots, by the version's hash, so only buckets of
    replaced versions are written anew; a version without new rows is just deleted."""
    at = SnapshotTable(new.sparkSession, path, [by])
    at.upsert(new, gone=versions)
    return at.read()


def write_reports(df: DataFrame, path: str, by: str = "slug") -> DataFrame:
    """Reports replace those of the same slug, in one step; gives all reports."""
    at = SnapshotTable(df.sparkSession, path, [by])
    at.upsert(df)
    return at.read()


def with_defaults(df: DataFrame, defaults: dict[str, object], kinds: dict[str, str]) -> DataFrame:
    """Adds missing columns and fills nulls: additive schema evolution."""
    for name, value in defaults.items():
        there = F.col(name) if name in df.columns else F.lit(None).cast(kinds[name])
        df = df.withColumn(name, there if value is None else F.coalesce(there, F.lit(value).cast(kinds[name])))
    return df


def setting(name: str, given: str | None, env_file: str | None, default: str, path: bool = False) -> str:
    """Argument, then environment, then the file's line NAME=value, then the default.

    A value out of the file that starts with a dot, or any with ``path``, is a path: a relative one is relative to the file's folder.
    """
    if given:
        return given
    if os.environ.get(name):
        return os.environ[name]
    if env_file and Path(env_file).exists():
        for line in Path(env_file).read_text(encoding="utf-8").splitlines():
            key, eq, value = line.partition("=")
            if eq and key.strip() == name:
                value = value.strip().strip("\"'")
                return str(Path(env_file).parent / value) if value.startswith(".") or (path and value and not Path(value).is_absolute()) else value
    return default
