"""Batch embedding with retries, and repair of weak section metadata, around pluggable services."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.core import fresh_path

#: Seconds before each further attempt (fixed values).
BACKOFF = (1, 4, 16, 60)


class EmbeddingError(ValueError):
    pass


def checked(vectors: list[list[float]], n: int, dim: int, tolerance: float = 1e-3) -> list[list[float]]:
    if len(vectors) != n:
        raise EmbeddingError(f"{n} texts gave {len(vectors)} vectors")
    for v in vectors:
        if len(v) != dim:
            raise EmbeddingError(f"a vector has {len(v)} dimensions, not {dim}")
        if not all(isinstance(x, (int, float)) and math.isfinite(x) for x in v):
            raise EmbeddingError("a vector has a value that isn't finite")
        if abs(math.sqrt(sum(x * x for x in v)) - 1) > tolerance:
            raise EmbeddingError("a vector's L2 norm isn't 1")
    return vectors


def embed_texts(texts: list[str], call: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 32, attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Vectors of all texts in order. A batch that times out is halved, both halves stay queued."""
    out: list[list[float]] = []
    todo = [texts[i : i + batch] for i in range(0, len(texts), batch)]
    while todo:
        part = todo.pop(0)
        for k in range(attempts):
            try:
                out += checked(call(part), len(part), dim)
                break
            except TimeoutError:
                if len(part) > 1:
                    half = len(part) // 2
                    todo[:0] = [part[:half], part[half:]]
                    break
                if k + 1 == attempts:
                    raise
                sleep(BACKOFF[min(k, len(BACKOFF) - 1)])
            except OSError:
                if k + 1 == attempts:
                    raise
                sleep(BACKOFF[min(k, len(BACKOFF) - 1)])
    return out


def embed_missing(chunks: DataFrame, done: DataFrame, call: Callable[[list[str]], list[list[float]]], dim: int, key: str = "chunk_id", batch: int = 32) -> DataFrame:
    """(key, embedding) of chunks that ``done`` lacks, batch by batch in each task."""
    todo = chunks.join(done.select(key).distinct(), key, "left_anti").select(F.col(key).cast("string"), F.coalesce("text", F.lit("")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "embedding": embed_texts(f["text"].tolist(), call, dim, batch)})

    return todo.mapInPandas(run, f"{key} string, embedding array<float>")


def append_vectors(chunks: DataFrame, path: str, call: Callable[[list[str]], list[list[float]]], dim: int, key: str = "chunk_id", batch: int = 32, parts: int = 16) -> None:
    """Appends vectors that the table at ``path`` lacks, a part of the keys at a time.

    Each part is committed by its own write, so a job that fails goes on after the last
    part that was written. A null key belongs to no part.
    """
    spark = chunks.sparkSession
    shape = f"{key} string, embedding array<float>"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    done = spark.read.schema(shape).parquet(path) if there else spark.createDataFrame([], shape)
    rows = chunks.select(F.col(key).cast("string").alias(key), "text").where(F.col(key).isNotNull())
    todo = rows.join(done.select(key).distinct(), key, "left_anti").withColumn("part", F.pmod(F.crc32(F.encode(F.col(key), "UTF-8")), F.lit(parts)).cast("int"))
    # the corpus is read once; each part has a folder of its own
    waiting = fresh_path(spark, "to-embed")
    todo.write.partitionBy("part").parquet(waiting)
    none = spark.createDataFrame([], shape)
    for i in range(parts):
        mine = spark.read.schema(todo.schema).parquet(waiting).where(F.col("part") == i)
        embed_missing(mine, none, call, dim, key, batch).write.mode("append").parquet(path)


def valid_repair(reply: str, sequence: set[int], source: str) -> dict | None:
    """A service's reply if it is exactly of the agreed form and every title is in the source."""
    try:
        got = json.loads(reply)
    except ValueError:
        return None
    if not isinstance(got, dict) or set(got) != {"sections", "regions"}:
        return None
    squeeze = lambda x: " ".join(str(x).split()).casefold()
    for s in got["sections"] if isinstance(got["sections"], list) else [None]:
        if not isinstance(s, dict) or set(s) != {"sequence_no", "section_ref", "title"} or s["sequence_no"] not in sequence or squeeze(s["title"]) not in squeeze(source):
            return None
    for r in got["regions"] if isinstance(got["regions"], list) else [None]:
        if not isinstance(r, dict) or set(r) != {"sequence_no", "region"} or r["sequence_no"] not in sequence:
            return None
    return got


def repair_spans(chunks: DataFrame, repair: Callable[[str], str], doc: str = "document_id") -> DataFrame:
    """Applies ``repair`` to runs of weak rows; any failure leaves rows as they are.

    ``chunks`` has span (null outside of runs), sequence_no, text, section_ref,
    section_title, document_region, metadata_source.
    """
    weak, sure = chunks.where("span IS NOT NULL"), chunks.where("span IS NULL")

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("sequence_no").copy()
        source = "\n".join(f["text"].fillna(""))
        try:
            got = valid_repair(repair(source), set(f["sequence_no"].tolist()), source)
        except Exception:  # noqa: BLE001  the service's own failures
            got = None
        if got:
            for s in got["sections"]:
                at = f["sequence_no"] == s["sequence_no"]
                f.loc[at, "section_ref"], f.loc[at, "section_title"], f.loc[at, "metadata_source"] = s["section_ref"], s["title"], "llm_repair"
            for r in got["regions"]:
                at = f["sequence_no"] == r["sequence_no"]
                f.loc[at, "document_region"], f.loc[at, "metadata_source"] = r["region"], "llm_repair"
        return f

    return weak.groupBy(doc, "span").applyInPandas(one, chunks.schema).unionByName(sure)
