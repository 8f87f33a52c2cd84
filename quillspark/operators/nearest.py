"""Exact nearest neighbours that rule out clusters and rows by the triangle inequality.

Vectors go to the nearest of some pivots and are stored in blocks: rows of one pivot
whose distances from it lie in one ring. A query knows its distance d to each pivot, so
a block with distances from lo to hi has no row nearer than max(d - hi, lo - d). A query
first reads the blocks with the least bounds that hold k rows; the k-th distance found
there rules out all blocks with a greater bound, and in the blocks that are read all
rows whose distance from the pivot differs from d by more.

How much that saves depends on the data: vectors in clusters leave few blocks, vectors
without any structure in many dimensions leave all (the second result tells).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.core import materialize
from quillspark.operators.search import ranked

#: Pivots at most, rings that a pivot's distances are counted in, blocks that fill a size, rows of a block at least, queries that meet a block at once.
PIVOTS, RINGS, BLOCKS, LEAST_BLOCK, QUERIES = 1024, 256, 65_536, 1024, 65_536


@dataclass
class Clusters:
    """``rows``: key, v, pivot, r (distance from it), block. One entry a block, ``PIVOTS`` * ``RINGS`` + ``BLOCKS`` at most."""

    rows: DataFrame
    pivots: np.ndarray
    block: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Queries x blocks: no row of the block is nearer."""
        far = distances(queries, self.pivots)
        d = far[:, self.pivot]
        # a row is nearer to its own pivot than to the query's, so it lies beyond the middle of both
        beyond = (d - far.min(axis=1, keepdims=True)) / 2
        return np.maximum(0, np.maximum(np.maximum(d - self.high, self.low - d), beyond)) * (1 - 1e-9)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((b - x) ** 2).sum(axis=1) for x in a])) if len(a) else np.zeros((0, len(b)))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", pivots: int | None = None, block_rows: int | None = None) -> Clusters:
    """Vectors in stored blocks. Null vectors are left out; all others have one length."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    many = given.count()
    # the number of pivots is bounded, whatever the number of vectors
    k = max(1, min(PIVOTS, pivots or int(many**0.5)))
    some = given.orderBy(F.xxhash64("key", "v")).select("v").limit(k).collect()
    centres = np.array([r["v"] for r in some], np.float64).reshape(len(some), -1)
    d = centres.shape[1]

    def nearest_pivot(batches):
        square = (centres * centres).sum(axis=1)
        for b in batches:
            v = matrix(b.column("v"), d)
            at = (square[None, :] - 2 * v @ centres.T).argmin(axis=1)
            r = np.sqrt(((v - centres[at]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("v"), pa.array(at, pa.int32()), pa.array(r)], names=["key", "v", "pivot", "r"])

    dealt = materialize(given.mapInArrow(nearest_pivot, f"key {dict(given.dtypes)['key']}, v array<double>, pivot int, r double"), "near-pivots")
    size = block_rows or max(LEAST_BLOCK, -(-many // BLOCKS))
    widest = F.broadcast(dealt.groupBy("pivot").agg(F.max("r").alias("widest")))
    ring = F.least(F.floor(F.when(F.col("widest") > 0, F.col("r") / F.col("widest") * RINGS).otherwise(0)), F.lit(RINGS - 1)).cast("int")
    ringed = dealt.join(widest, "pivot").withColumn("ring", ring)
    cells = ringed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))
    # neighbouring rings of a pivot share a block while they are small; a ring that is greater than a block is dealt by the key
    ahead = F.sum("n").over(Window.partitionBy("pivot").orderBy("ring")) - F.col("n")
    cells = materialize(cells.withColumns({"group": F.floor(ahead / size), "parts": F.greatest(F.lit(1), F.ceil(F.col("n") / size))}), "rings")
    meta = cells.groupBy("pivot", "group").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.max("parts").alias("parts")).orderBy("pivot", "group").collect()
    firsts = np.cumsum([0, *(m["parts"] for m in meta)])
    named = spark.createDataFrame([(m["pivot"], m["group"], int(f), m["parts"]) for m, f in zip(meta, firsts)], "pivot int, group long, first long, all_parts long")
    blocks_of = cells.select("pivot", "ring", "group").join(named, ["pivot", "group"])
    block = F.col("first") + F.pmod(F.xxhash64("key", "v"), F.col("all_parts"))
    rows = materialize(ringed.join(F.broadcast(blocks_of), ["pivot", "ring"]).select("key", "v", "pivot", "r", block.alias("block")), "blocks")
    each = np.repeat(np.arange(len(meta)), [m["parts"] for m in meta])
    column = lambda c: np.array([m[c] for m in meta], np.float64)[each] if meta else np.zeros(0)
    return Clusters(rows, centres, np.arange(len(each)), column("pivot").astype(np.int64), column("low"), column("high"), column("n") / np.maximum(column("parts"), 1))


def visits(queries: DataFrame, clusters: Clusters, k: int) -> DataFrame:
    """(query_no, query_id, v, tau, block, n_rows): which blocks each query reads.

    ``queries``: query_no, query_id, v, tau (a distance that k rows are known to be
    within, or null). Without a bound a query reads the blocks with the least bounds that hold
    more than k rows; with one it reads those of all others whose bound is within it.
    """
    c = Clusters(None, clusters.pivots, clusters.block, clusters.pivot, clusters.low, clusters.high, clusters.n)
    d = clusters.pivots.shape[1]

    def read(batches):
        for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            bound = c.bounds(matrix(b.column("v"), d))
            order = np.argsort(bound, axis=1, kind="stable")
            held = np.take_along_axis(np.broadcast_to(c.n, bound.shape), order, axis=1).cumsum(axis=1)
            home = np.zeros(bound.shape, bool)
            # rows dealt by the key are counted on average, so some more are read
            np.put_along_axis(home, order, (held - np.take_along_axis(np.broadcast_to(c.n, bound.shape), order, axis=1)) < 2 * k + 8, axis=1)
            tau = b.column("tau").to_numpy(zero_copy_only=False).astype(np.float64)
            chosen = np.where(np.isnan(tau)[:, None], home, ~home & (bound <= tau[:, None]))
            i, j = np.nonzero(chosen)
            rows = pa.array(i)
            yield pa.RecordBatch.from_arrays([*(b.column(x).take(rows) for x in ("query_no", "query_id", "v", "tau")), pa.array(c.block[j], pa.int64()), pa.array(c.n[j])], names=["query_no", "query_id", "v", "tau", "block", "n_rows"])

    kind = dict(queries.dtypes)["query_id"]
    return queries.select("query_no", "query_id", "v", "tau").mapInArrow(read, f"query_no long, query_id {kind}, v array<double>, tau double, block long, n_rows double")


def meet(asked: DataFrame, clusters: Clusters, k: int, n_queries: int) -> DataFrame:
    """(query_no, query_id, key, distance, block, compared): the k best of each block for the queries that read it, and how many rows of it were measured."""
    pivots, d = clusters.pivots, clusters.pivots.shape[1]
    kind = dict(clusters.rows.dtypes)["key"]
    parts = max(1, -(-n_queries // QUERIES))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks().sort_by("r")
        out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, np.int64))]
        if left.num_rows:
            v, r, centre = matrix(left.column("v").combine_chunks(), d), left.column("r").to_numpy(), pivots[left.column("pivot")[0].as_py()]
            tau = right.column("tau").to_numpy()
            for i, q in enumerate(matrix(right.column("v").combine_chunks(), d) if right.num_rows else ()):
                away, a, b = np.sqrt(((q - centre) ** 2).sum()), 0, len(r)
                if not np.isnan(tau[i]):
                    slack = tau[i] + 1e-9 * (away + tau[i])
                    a, b = np.searchsorted(r, away - slack), np.searchsorted(r, away + slack, "right")
                far = np.sqrt(((v[a:b] - q) ** 2).sum(axis=1))
                edge = np.partition(far, k - 1)[k - 1] if len(far) > k else np.inf
                near = np.flatnonzero(far <= edge)  # ties stay, the key decides later
                out.append((np.full(len(near), i), a + near, far[near], np.full(len(near), b - a)))
        at, row, far, compared = (np.concatenate(x) for x in zip(*out))
        at, row = pa.array(at), pa.array(row)
        return pa.table({"query_no": right.column("query_no").take(at), "query_id": right.column("query_id").take(at), "key": left.column("key").take(row), "distance": far, "block": left.column("block").take(row), "compared": pa.array(compared, pa.int64())})

    rows = clusters.rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.withColumn("part", (F.col("query_no") % parts).cast("int"))
    schema = f"query_no long, query_id {dict(asked.dtypes)['query_id']}, key {kind}, distance double, block long, compared long"
    return rows.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(best, schema)


def nearest_in_clusters(queries: DataFrame, clusters: Clusters, k: int, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """((query_id, key, distance, rank), (query_no, block, compared)): the k nearest of all rows for each query, exactly, ties by key; and how many rows of which blocks were measured for it."""
    rows = queries.select("query_id", F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    rows = materialize(rows.withColumn("query_no", F.monotonically_increasing_id()), "near-queries")
    many = rows.count()
    home = materialize(visits(rows.withColumn("tau", F.lit(None).cast("double")), clusters, k), "near-home")
    first = materialize(meet(home, clusters, k, many), "near-first")
    seen = Window.partitionBy("query_no").orderBy("distance")
    bars = first.withColumn("nth", F.row_number().over(seen)).where(F.col("nth") == k).select("query_no", F.col("distance").alias("tau"))
    # a query whose home holds fewer than k rows reads everything
    told = rows.join(bars, "query_no", "left").withColumn("tau", F.coalesce("tau", F.lit(float("inf"))))
    rest = materialize(visits(told, clusters, k), "near-rest")
    found = materialize(first.unionByName(meet(rest, clusters, k, many)), "near-found")
    got = ranked(found, [F.col("distance"), F.col("key")], k, by="query_no").select("query_id", F.col("key").alias(key), "distance", "rank")
    return got, found.select("query_no", "block", "compared").distinct()
