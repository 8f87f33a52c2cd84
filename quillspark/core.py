"""Session settings, shared storage and table access used by every operator."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Where that is unset, as in tests of a
    single process, a temporary folder takes its place; a cluster must set it.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="quillspark-"))
    return _OWN_DIR[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage: a lost executor costs only the tasks it ran, and later
    steps start from columnar files with column pruning.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.format(fmt).option("compression", "zstd").save(path)
    return spark.read.schema(df.schema).format(fmt).load(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def small_enough(spark: SparkSession, df: DataFrame, limit_bytes: int) -> bool:
    """Whether the optimizer's size estimate of ``df`` is within ``limit_bytes``.

    Parquet estimates are the files' bytes scaled by the share of columns read, so
    callers keep ``limit_bytes`` well below what an executor could hold.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit_bytes


def arrow_store(folder: str):
    """(file system of Arrow, path there) of a folder as Hadoop names it."""
    from pyarrow import fs

    # stores that go by another name there
    scheme, colon, rest = folder.partition(":")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + colon + rest)


def spread(df: DataFrame, limit_bytes: int = 128 << 20) -> DataFrame:
    """A small ``df`` dealt to all cores, since its files may be read by one task; a larger one as it is read."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if small_enough(df.sparkSession, df, limit_bytes) else df


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of one name in which null equals null.

    The right side's keys are renamed first, so both sides may stem from one plan.
    """
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = all_of([F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(other, same, how).drop(*(f"__right_{k}" for k in keys))
